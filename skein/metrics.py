"""Counts of what passes a stage, and a log of them."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("skein")


def log_to(path: str | Path | None = None, level: int = logging.INFO) -> logging.Logger:
    """The log on the console, and appended to a file where one is named. Calling it again adds nothing."""
    LOG.setLevel(level)
    handlers: list[logging.Handler] = [] if any(type(h) is logging.StreamHandler for h in LOG.handlers) else [logging.StreamHandler()]
    if path is not None and not any(getattr(h, "baseFilename", None) == str(Path(path).resolve()) for h in LOG.handlers):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(path).resolve(), encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        LOG.addHandler(h)
    return LOG


class Metrics:
    """Counts that are taken while a stage runs, without a pass of their own.

    seen() adds counts to a stage's rows; after an action on them, get() has the numbers and report()
    logs them. A stage that runs again counts its first run.
    """

    def __init__(self) -> None:
        self.observed: dict[str, Observation] = {}

    def seen(self, df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        o = self.observed[stage] = Observation(stage)
        return df.observe(o, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()])

    def get(self, stage: str) -> dict[str, int]:
        return dict(self.observed[stage].get)

    def report(self) -> dict[str, dict[str, int]]:
        out = {stage: self.get(stage) for stage in self.observed}
        for stage, numbers in out.items():
            LOG.info("%s: %s", stage, ", ".join(f"{k} {v}" for k, v in numbers.items()))
        return out


def diagnostics() -> dict[str, str | None]:
    """Versions of what the package uses; None for what isn't installed."""
    from importlib import metadata

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return {name: version(name) for name in ("pyspark", "pyarrow", "pandas", "numpy", "pyyaml")}
