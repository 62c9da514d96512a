"""Logs, timing, sizes, folders and the environment of a run."""

from __future__ import annotations

import logging
import os
import platform
import shutil
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def duration(seconds: float) -> str:
    """1.50 s, 2 min 5 s, 3 h 4 min."""
    if seconds < 60:
        return f"{seconds:.2f} s"
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes} min {rest} s" if minutes < 60 else f"{minutes // 60} h {minutes % 60} min"


def size(n: float) -> str:
    """Bytes in the largest unit that gives at least one."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def logger(name: str = "loamgrid", level: str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger to standard error and, where given, a file; asked for again it is the same one."""
    log = logging.getLogger(name)
    log.setLevel(level)
    line = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    wanted: list[logging.Handler] = [] if log.handlers else [logging.StreamHandler(sys.stderr)]
    if path and not any(getattr(h, "baseFilename", None) == os.path.abspath(path) for h in log.handlers):
        wanted.append(logging.FileHandler(path, encoding="utf-8"))
    for h in wanted:
        h.setFormatter(line)
        log.addHandler(h)
    return log


def logged(log: logging.Logger, *errors: type[BaseException]) -> Callable:
    """A decorator that logs the errors of a function and raises them again."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kw):
            try:
                return f(*args, **kw)
            except (errors or (Exception,)) as e:
                log.error("%s failed: %s", f.__name__, e)
                raise

        return run

    return wrap


def describe(df: DataFrame, name: str = "table") -> str:
    """Columns and partitions of a table, without running it."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return f"{name}: {len(df.columns)} columns ({kinds})"


@dataclass
class Monitor:
    """Seconds of named steps and values of named metrics."""

    log: logging.Logger | None = None
    steps: list[tuple[str, float]] = field(default_factory=list)
    metrics: dict[str, list[float]] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.steps.append((name, time.perf_counter() - start))
            if self.log:
                self.log.info("%s took %s", name, duration(self.steps[-1][1]))

    def record(self, name: str, value: float) -> None:
        self.metrics.setdefault(name, []).append(value)

    def summary(self) -> dict[str, dict[str, float]]:
        times: dict[str, list[float]] = {}
        for name, seconds in self.steps:
            times.setdefault(name, []).append(seconds)
        return {k: {"n": len(v), "mean": sum(v) / len(v), "min": min(v), "max": max(v), "total": sum(v)} for k, v in {**times, **self.metrics}.items()}


class Progress:
    """How far a count of steps has come, and about how long the rest takes."""

    def __init__(self, total: int, name: str = "", log: logging.Logger | None = None, clock: Callable[[], float] = time.perf_counter) -> None:
        self.total, self.name, self.log, self.clock, self.done = total, name, log, clock, 0
        self.start = clock()

    def update(self, n: int = 1) -> str:
        self.done = min(self.total, self.done + n)
        passed = self.clock() - self.start
        rest = passed / self.done * (self.total - self.done) if self.done else 0.0
        line = f"{self.name} {self.bar()} {self.done}/{self.total}, {duration(rest)} left".strip()
        if self.log:
            self.log.info(line)
        return line

    def bar(self, width: int = 20) -> str:
        full = width * self.done // self.total if self.total else width
        return "[" + "#" * full + "." * (width - full) + "]"


def memory() -> dict[str, int]:
    """Bytes of memory: total, available, and held by this process (0 where not known)."""
    out = {"total": 0, "available": 0, "process": 0}
    try:
        with open("/proc/meminfo", encoding="ascii") as f:
            info = {k: int(v.split()[0]) * 1024 for k, v in (line.split(":", 1) for line in f if "kB" in line)}
        with open("/proc/self/statm", encoding="ascii") as f:
            out["process"] = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        out |= {"total": info.get("MemTotal", 0), "available": info.get("MemAvailable", 0)}
    except OSError:
        pass
    return out


def memory_is_enough(wanted: int, share: float = 0.8) -> bool:
    """Whether ``wanted`` bytes fit in a share of the memory that is left; true where that isn't known."""
    free = memory()["available"]
    return not free or wanted <= free * share


def system() -> dict[str, str]:
    m = memory()
    return {"python": platform.python_version(), "system": platform.platform(), "cpus": str(os.cpu_count()), "memory": size(m["total"]), "free": size(m["available"])}


def environment_issues(spark: SparkSession, modules: tuple[str, ...] = ("numpy", "pandas", "pyarrow")) -> list[str]:
    """What a run would miss: Python modules, a shared checkpoint folder on a cluster, adaptive execution."""
    from importlib.util import find_spec

    out = [f"module {m} is missing" for m in modules if find_spec(m) is None]
    if not spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
        out.append("spark.checkpoint.dir isn't set")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        out.append("adaptive execution is off")
    return out


def folder(path: str) -> str:
    """A local folder, made where it is missing."""
    os.makedirs(path, exist_ok=True)
    return path


def output_folders(root: str, names: tuple[str, ...] = ("maps", "metrics", "reports", "models")) -> dict[str, str]:
    return {n: folder(os.path.join(root, n)) for n in names}


def file_size(path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    if os.path.isfile(path):
        return os.path.getsize(path)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def remove_old(path: str, seconds: float, suffix: str = "") -> list[str]:
    """Files directly in a local folder that are older than so many seconds, removed."""
    now, gone = time.time(), []
    for name in sorted(os.listdir(path)):
        at = os.path.join(path, name)
        if os.path.isfile(at) and name.endswith(suffix) and now - os.path.getmtime(at) > seconds:
            os.remove(at)
            gone.append(name)
    return gone


def forget(spark: SparkSession, *folders: str) -> None:
    """Cached tables dropped, and local folders removed."""
    spark.catalog.clearCache()
    for f in folders:
        shutil.rmtree(f, ignore_errors=True)


def summary_lines(title: str, values: dict[str, object]) -> list[str]:
    """A title and aligned names with values, as a run's last words."""
    wide = max((len(k) for k in values), default=0)
    return [title, "-" * len(title), *(f"{k:<{wide}}  {v:.4f}" if isinstance(v, float) else f"{k:<{wide}}  {v}" for k, v in values.items())]
