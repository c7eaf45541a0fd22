"""What a task that holds a model asks of an executor, so that no more of them run at once than fit."""

from math import ceil

from pyspark.resource import ResourceProfile, TaskResourceRequests
from pyspark.resource.profile import ResourceProfileBuilder

# Memory of the speech models in GB, in 8-bit integers and in half precision.
MEMORY = {"tiny": (0.5, 1.0), "base": (0.7, 1.3), "small": (1.2, 2.0), "medium": (3.5, 5.5), "large-v3": (6.5, 10.0)}


def memory_of(model: str, compute_type: str) -> float:
    """GB that a model takes; an unknown one as much as the largest."""
    whole, half = MEMORY.get(model, MEMORY["large-v3"])
    return half if compute_type == "float16" else whole


def task_profile(model: str, compute_type: str, device: str, executor_gb: float, executor_cores: int) -> ResourceProfile:
    """For mapInPandas(..., profile=...): a graphics card a task on `cuda`; else as many cores as the model's share of the executor's memory is of its cores, so that models running at once fit into it."""
    asks = TaskResourceRequests()
    if device == "cuda":
        asks = asks.cpus(1).resource("gpu", 1)
    else:
        asks = asks.cpus(min(executor_cores, max(1, ceil(memory_of(model, compute_type) / (executor_gb / executor_cores)))))
    return ResourceProfileBuilder().require(asks).build
