"""Tasks: training rows and held-out candidates with features, made from users, items and interactions without leakage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.functions.scratch import written
from slateworks.operators import candidates, policies, scorers, splits
from slateworks.operators.filters import min_interactions, require_columns, with_target
from slateworks.operators.joins import enrich


@dataclass(frozen=True)
class TaskConfig:
    """min_rows: interactions a user needs; m negatives for a positive; total rows of a user's groups; last: length of histories."""

    min_rows: int = 10
    train: float = 0.7
    val: float = 0.1
    test: float = 0.2
    m: int = 3
    total: int = 20
    max_groups: int | None = 5
    k: int = 5
    seed: int = 0
    context: tuple[str, ...] = ("rating", "playtime")


@dataclass
class Task:
    """rows: one table with a split column; a row that is not training has null context columns."""

    rows: DataFrame
    target: str
    features: list[str]
    manifest: dict = field(default_factory=dict)

    def split(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    def xy(self, name: str) -> tuple[DataFrame, DataFrame]:
        part = self.split(name)
        return part.drop(self.target), part.select(self.target)


def described(part):
    """A component as values for a manifest: class and parameters, those that are components themselves too."""
    if is_dataclass(part) and not isinstance(part, type):
        return {"class": type(part).__name__, "params": {f.name: described(getattr(part, f.name)) for f in fields(part)}}
    if isinstance(part, dict):
        return {k: described(v) for k, v in part.items()}
    if isinstance(part, (list, tuple)):
        return [described(v) for v in part]
    if part is None or isinstance(part, (str, int, float, bool)):
        return part
    return {"class": getattr(part, "__name__", type(part).__name__), "params": {k: described(v) for k, v in vars(part).items()} if hasattr(part, "__dict__") and not callable(part) else {}}


def item_statistics(train: DataFrame, rating: str = "rating") -> DataFrame:
    """(item_id, mean_rating, rating_count) from training rows only."""
    return train.groupBy("item_id").agg(F.avg(rating).alias("mean_rating"), F.count(rating).alias("rating_count"))


def with_item_statistics(items: DataFrame, train: DataFrame) -> DataFrame:
    """items with the statistics; unrated ones have count 0 and no mean."""
    return items.join(item_statistics(train), "item_id", "left").withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))


def _finished(observed: DataFrame, held: DataFrame, users: DataFrame, items: DataFrame, config: TaskConfig, sampled: bool = True) -> Task:
    """Training rows and held-out candidates as one table with features; context is null in the latter."""
    context = [c for c in config.context if c in observed.columns]
    train = observed.where("split = 'train'").select("split", "user_id", "item_id", F.lit(None).cast("string").alias("candidate_group"), F.lit(1).alias("y"), F.lit(False).alias("sampled"), *context)
    kinds = dict(observed.dtypes)
    rest = held.select("split", "user_id", "item_id", F.concat_ws(":", "user_id", "split", F.col("chunk").cast("string")).alias("candidate_group"), F.col("y").cast("int").alias("y"), (F.col("y") == 0).alias("sampled"), *(F.lit(None).cast(kinds[c]).alias(c) for c in context))
    both = train.unionByName(rest)
    both = both if sampled else both.drop("sampled")
    stats = with_item_statistics(items, observed.where("split = 'train'")) if "rating" in context else items
    out = enrich(both, users, stats)
    features = [c for c in out.columns if c.startswith(("user_", "item_")) and c not in ("user_id", "item_id")]
    return Task(out, "y", features, {"config": described(config)})


def alignment_candidates(rows: DataFrame, kept: DataFrame, items: DataFrame, config: TaskConfig) -> DataFrame:
    """(user_id, chunk, item_id, y, split): held-out positives of rows among items the user never touched in kept.

    Negatives of val do not return in test.
    """
    index = written(candidates.indexed(items), "index")

    def make(name: str, excluded: DataFrame | None) -> DataFrame:
        part = rows.where(F.col("split") == name)
        found = candidates.non_interactions(part, items, kept, config.m, config.total, config.seed, f"negative-{name}", max_groups=config.max_groups, excluded=excluded, index=index)
        return found.withColumn("split", F.lit(name))

    val = written(make("val", None), "val")
    return val.unionByName(make("test", val.where("y = 0")))


def alignment(users: DataFrame, items: DataFrame, interactions: DataFrame, config: TaskConfig) -> Task:
    """Observed training rows; held-out positives among items the user never touched. Negatives of val do not return in test."""
    require_columns(interactions, "user_id", "item_id")
    kept = written(min_interactions(interactions, config.min_rows), "kept")
    rows = written(splits.random_fractions(kept, config.train, config.val, config.test, config.seed), "split")
    return _finished(rows, alignment_candidates(rows, kept, items, config), users, items, config)


def preference(users: DataFrame, items: DataFrame, interactions: DataFrame, config: TaskConfig, liked: str = "liked") -> Task:
    """Held-out groups of liked and disliked items, all observed."""
    rows = written(splits.random_fractions(min_interactions(interactions, config.min_rows), config.train, config.val, config.test, config.seed), "split")
    parts = [candidates.observed_preferences(rows.where(F.col("split") == name), liked, config.m, config.total, config.seed, config.max_groups).withColumn("split", F.lit(name)) for name in ("val", "test")]
    return _finished(rows, parts[0].unionByName(parts[1]), users, items, config, sampled=False)


def regression(users: DataFrame, items: DataFrame, interactions: DataFrame, config: TaskConfig, target: str = "rating") -> Task:
    """Observed rows with a target; no groups."""
    rows = written(splits.random_fractions(with_target(min_interactions(interactions, config.min_rows), target), config.train, config.val, config.test, config.seed), "split")
    base = rows.select("split", "user_id", "item_id", F.col(target).alias("y"))
    out = enrich(base, users, with_item_statistics(items, rows.where("split = 'train'")))
    return Task(out, "y", [c for c in out.columns if c.startswith(("user_", "item_")) and c not in ("user_id", "item_id")], {"config": described(config)})


def cold_start(users: DataFrame, items: DataFrame, interactions: DataFrame, config: TaskConfig) -> Task:
    """Warm users train; each cold user has k rows of history and groups in order of time after it."""
    kept = min_interactions(interactions, config.min_rows)
    rows = written(splits.cold_users(kept, config.k, config.val, config.test, config.seed), "cold")
    cold = rows.where("split <> 'train'")
    parts = []
    for name in ("val", "test"):
        found = candidates.non_interactions(rows.where(F.col("split") == name), items, cold, config.m, config.total, config.seed, f"cold-{name}", temporal=("position",), max_groups=config.max_groups)
        parts.append(found.withColumn("split", F.lit(name)))
    task = _finished(rows.withColumn("split", F.when(F.col("split") == "history", "train").otherwise(F.col("split"))), parts[0].unionByName(parts[1]), users, items, config)
    past = rows.where("split = 'history'").select("user_id", "item_id").withColumn("_history", F.lit(True))
    marked = task.rows.join(past, ["user_id", "item_id"], "left")
    split = F.when((F.col("split") == "train") & F.col("_history").isNotNull(), "history").otherwise(F.col("split"))
    task.rows = marked.withColumn("split", split).select(*task.rows.columns)
    return task


def policy_ranking(users: DataFrame, items: DataFrame, interactions: DataFrame, config: TaskConfig, recommenders: dict, k: int = 10) -> Task:
    """(user, policy, item, rank, y): what each policy shows, with the held-out target of it."""
    rows = written(splits.random_fractions(min_interactions(interactions, config.min_rows), config.train + config.val, 0.0, config.test, config.seed), "split")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    shown = None
    for recommend in recommenders.values():
        part = recommend(train, test.select("user_id").distinct(), items, k)
        shown = part if shown is None else shown.unionByName(part)
    targets = policies.with_targets(shown, test.withColumn("y", F.lit(1)))
    out = enrich(targets.withColumn("split", F.lit("test")), users, items)
    return Task(out, "y", [c for c in out.columns if c.startswith(("user_", "item_")) and c not in ("user_id", "item_id")], {"config": described(config)})


def popularity_scored(task: Task, names: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Held-out rows with the popularity of their item in training."""
    return scorers.score_popularity(task.split("train"), task.rows.where(F.col("split").isin(*names)))


#: Negatives for a positive, of each kind of task that has groups, with the most rows of a user's group.
GRIDS = {"interaction": ((1, 2, 3, 9, 19), 20), "preference": ((1, 2, 3, 9), 10), "cold_start": ((1, 2, 3, 9, 19), 20)}


def registered(kind: str, seeds: tuple[int, ...] = (0,), sizes: tuple[int, ...] = (5,)) -> dict[str, tuple]:
    """Name -> (builder, config) of every task of a kind: for each m of its grid, each seed, and each k of cold start."""
    if kind == "regression":
        return {f"regression_seed{seed}": (regression, TaskConfig(seed=seed)) for seed in seeds}
    builder = {"interaction": alignment, "preference": preference, "cold_start": cold_start}[kind]
    ms, cap = GRIDS[kind]
    ks = sizes if kind == "cold_start" else (TaskConfig.k,)
    part = lambda k: f"_k{k}" if kind == "cold_start" else ""
    return {f"{kind}{part(k)}_m{m}_seed{seed}": (builder, TaskConfig(m=m, total=max(m + 1, cap), k=k, seed=seed)) for m in ms for k in ks for seed in seeds}


def grid(tasks: dict[str, tuple], methods: dict[str, Callable[[Task], object]], users: DataFrame, items: DataFrame, interactions: DataFrame, done: frozenset = frozenset()) -> Iterator[tuple[str, str, object]]:
    """(task, method, result) of each task with each method, but for pairs in done, which an earlier run finished."""
    for name, (builder, config) in tasks.items():
        left = [m for m in methods if (name, m) not in done]
        if left:
            task = builder(users, items, interactions, config)
            for method in left:
                yield name, method, methods[method](task)
