"""The reference analyses end to end, each as one chain of operators."""
