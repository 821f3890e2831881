"""Structured Streaming operators."""

from .accuracy import run_running_accuracy, running_accuracy, running_accuracy_by_batch
from .keyed import keyed_accuracy, run_keyed_accuracy

__all__ = ["keyed_accuracy", "run_keyed_accuracy", "running_accuracy", "run_running_accuracy", "running_accuracy_by_batch"]
