"""Facts of a host, and the profile that follows from them. What asks the host is injected; whatever fails gives no fact."""

import json
import platform
import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cueforge.operators import profiles

Asker = Callable[[list[str]], str]
#: Bytes, kilobytes and mebibytes in a gigabyte.
PER_GB = {"bytes": 2**30, "kB": 2**20, "MiB": 2**10}
FACTS = "os string, arch string, ram double, apple_chip string, vram double"
#: Where the first number is the memory, and its unit.
_MEMORY = {
    "linux": (["cat", "/proc/meminfo"], r"MemTotal:\s+(\d+)", "kB"),
    "darwin": (["sysctl", "-n", "hw.memsize"], r"(\d+)", "bytes"),
    "windows": (["wmic", "ComputerSystem", "get", "TotalPhysicalMemory"], r"\b(\d+)\b", "bytes"),
}
_GPU = (["nvidia-smi", "--query-gpu=memory.total", "--format=csv,noheader,nounits"], r"\A\s*(\d+)\s*$", "MiB")
_CHIP = (["system_profiler", "SPHardwareDataType"], r"(?m)^.*?Chip(?:set)?\b[^:\n]*:[ \t]*(.*?)[ \t]*$")


class UnknownField(KeyError):
    """No such field of a profile."""


def ask(command: list[str]) -> str:
    return subprocess.run(command, capture_output=True, text=True, check=True, timeout=10).stdout


def gigabytes(amount: Column, unit: str) -> Column:
    return amount / F.lit(float(PER_GB[unit]))


def _found(asker: Asker, command: list[str], pattern: str) -> str | None:
    try:
        hit = re.search(pattern, asker(command), re.M)
    except (OSError, ValueError, subprocess.SubprocessError):
        return None
    return hit[1] if hit else None


def facts(asker: Asker = ask, system: str | None = None, machine: str | None = None) -> tuple:
    """(os, arch, ram, apple_chip, vram) of this host, by FACTS: ram in GB, 0 if unknown; chip and vram of the first graphics card or None."""
    system, machine = (system or platform.system()).lower(), (machine or platform.machine()).lower()
    number = lambda command, pattern, unit: None if (x := _found(asker, command, pattern)) is None else int(x) / PER_GB[unit]
    ram = number(*_MEMORY[system]) if system in _MEMORY else None
    chip = _found(asker, *_CHIP) if (system, machine) == ("darwin", "arm64") else None
    return system, machine, ram or 0.0, chip, number(*_GPU)


def described(hosts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """hosts(os, arch, ram, apple_chip, vram) -> the eleven fields of a profile, after columns to keep; memory is rounded for display, after the choice."""
    chosen = hosts.withColumn("profile", profiles.select_profile(F.col("ram"), F.col("vram"), F.coalesce(F.col("apple_chip") != "", F.lit(False))))
    shown = {"ram_gb": F.bround("ram", 1), "nvidia_vram_gb": F.when(F.col("vram") != 0, F.bround("vram", 1)), "asr_model": F.col("asr"), "compute_type": F.col("compute"), "vlm_model": F.col("vlm")}
    return profiles.look_up(chosen).withColumns(shown).select(*(keep or []), "os", "arch", "ram_gb", "apple_chip", "nvidia_vram_gb", "profile", "asr_model", "compute_type", "device", "vlm_model", "note")


def detect(spark: SparkSession, asker: Asker = ask) -> Row:
    """The profile of the driver's host."""
    return described(spark.createDataFrame([facts(asker)], FACTS)).first()


def of_executors(spark: SparkSession, tasks: int | None = None, asker: Asker = ask) -> DataFrame:
    """(host, and the eleven fields of a profile) of the hosts that executors run on, a row a host. tasks: how many ask; as many as the cluster runs at once by default, which on a busy one may leave a host unasked."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([(platform.node(), *facts(asker))], columns=["host", *(f.split()[0] for f in FACTS.split(", "))])

    n = tasks or spark.sparkContext.defaultParallelism
    rows = spark.range(n).repartition(n).mapInPandas(told, f"host string, {FACTS}").dropDuplicates(["host"])
    return described(rows, keep=["host"])


def field(profile: Row, key: str):
    if key not in profile.__fields__:
        raise UnknownField(f"unknown key '{key}'; valid: {', '.join(sorted(profile.__fields__))}")
    return profile[key]


def default(profile: Callable[[], Row], key: str, otherwise):
    """A field as a default for other commands; `otherwise` where nothing can be found out."""
    try:
        return field(profile(), key) or otherwise
    except Exception:  # whatever fails, the command still runs
        return otherwise


def as_text(profile: Row) -> str:
    """The profile for a reader, a line for each fact that is known."""
    rows = [("host", f"{profile.os}/{profile.arch}"), ("memory", f"{profile.ram_gb} GB"), ("chip", profile.apple_chip), ("graphics", profile.nvidia_vram_gb and f"{profile.nvidia_vram_gb} GB")]
    rows += [(k, profile[k]) for k in ("asr_model", "compute_type", "device", "vlm_model")]
    return "\n".join([f"{profile.profile}: {profile.note}", *(f"  {k:<13}{v}" for k, v in rows if v)])


def as_json(profile: Row) -> str:
    return json.dumps(profile.asDict(), ensure_ascii=False, indent=2)
