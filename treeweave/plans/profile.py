"""Timings of strategies, by labelled stage, and captured plans."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..sources.files import run_only
from .contributions import count_output
from .strategies import STRATEGIES, evaluate, full_reduce
from .tree import JoinTree


@dataclass
class Profile:
    seconds: dict[str, float] = field(default_factory=dict)
    rows: int | None = None

    def ratio(self, a: str, b: str) -> float:
        return self.seconds[a] / max(self.seconds[b], 1e-9)


@contextlib.contextmanager
def stage(profile: Profile, name: str, spark) -> Iterator[None]:
    """Times what is run inside, whose Spark jobs carry the name as their group."""
    spark.sparkContext.setJobGroup(name, name)
    began = time.perf_counter()
    try:
        yield
    finally:
        profile.seconds[name] = profile.seconds.get(name, 0.0) + time.perf_counter() - began
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def profile_tree(tree: JoinTree, strategies=STRATEGIES, warm: bool = True, repeats: int = 1) -> Profile:
    """Seconds for counting, reducing, and each strategy over the whole output, which is made and thrown away."""
    spark, out = tree.relations[tree.root].sparkSession, Profile()
    if warm:
        run_only(evaluate(tree))
    with stage(out, "size", spark):
        out.rows = count_output(tree)
    with stage(out, "reduce", spark):
        for df in full_reduce(tree).values():
            run_only(df)
    for s in strategies:
        for _ in range(repeats):
            with stage(out, s, spark):
                run_only(evaluate(tree, s))
        out.seconds[s] /= repeats
    return out


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()
