"""One filter for lists, aggregates, exports and feeds; all its conditions must hold."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.text import LEVELS, MOST_ENVIRONMENT
from spanloom.functions.time import duration_ms
from spanloom.operators.figures import figured
from spanloom.operators.versions import latest

#: Bounds of what a caller may ask.
MOST_LIMIT, DEFAULT_LIMIT, MOST_TEXT, MOST_DURATION, MOST_COST = 100, 20, 200, 2**53 - 1, Decimal(10) ** 12


def _number(text: str, most: Decimal | int, least: int = 0, whole: bool = False) -> Decimal:
    try:
        number = Decimal(text.strip())
    except InvalidOperation:
        raise ValueError(f"{text!r} is no number") from None
    if not number.is_finite() or not least <= number <= most or (whole and number != number.to_integral_value()):
        raise ValueError(f"{text} is out of range")
    return number


def _environment(name: str) -> str:
    clean = unicodedata.normalize("NFC", name).strip()
    if not clean or len(clean) > MOST_ENVIRONMENT or any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in clean):
        raise ValueError("no name of an environment")
    return clean


def page_limit(params: dict[str, str]) -> int:
    """How many rows a page has: what was asked, from 1 to 100, else 20. Raises ValueError for anything else."""
    asked = params.get("limit")
    return DEFAULT_LIMIT if asked is None else int(_number(asked, MOST_LIMIT, least=1, whole=True))


@dataclass(frozen=True)
class TraceFilter:
    """Unset conditions are None; blank text and an empty tag list count as unset."""

    project_id: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    user_id: str | None = None
    session_id: str | None = None
    environment: str | None = None
    tags: tuple[str, ...] = ()
    metadata: tuple[str, str] | None = None
    search: str | None = None
    level: str | None = None
    model: str | None = None
    min_duration_ms: int | None = None
    min_cost: Decimal | None = None
    settled_before: datetime | None = None

    @staticmethod
    def from_params(params: dict[str, str]) -> TraceFilter:
        """From request parameters: blank as unset, searched text and model trimmed, environments in composed form,
        ids and metadata as they are. Raises ValueError for what is out of bounds or no number."""
        given = {k: v for k, v in params.items() if v is not None and v.strip()}
        given |= {k: given[k].strip() for k in ("search", "model", "level", "since", "until") if k in given}
        if any(len(given.get(k, "").encode("utf-16-le", "surrogatepass")) > 2 * MOST_TEXT for k in ("search", "model")):
            raise ValueError(f"text of over {MOST_TEXT} characters")
        if given.get("level", LEVELS[0]) not in LEVELS:
            raise ValueError("unknown level")
        if "environment" in given:
            given["environment"] = _environment(given["environment"])
        duration = _number(given["min_duration_ms"], MOST_DURATION, whole=True) if "min_duration_ms" in given else None
        cost = _number(given["min_cost"], MOST_COST) if "min_cost" in given else None
        times = {k: datetime.fromisoformat(given[k]) for k in ("since", "until") if k in given}
        key, value = given.get("metadata_key"), given.get("metadata_value")
        tags = tuple(t for t in (x.strip() for x in given.get("tags", "").split(",")) if t)
        text = {k: given.get(k) for k in ("project_id", "user_id", "session_id", "environment", "search", "level", "model")}
        return TraceFilter(**text, **times, tags=tags, metadata=(key, value) if key and value else None, min_duration_ms=None if duration is None else int(duration), min_cost=cost)

    @property
    def narrows(self) -> bool:
        """Whether conditions on traces alone leave few enough to look at only their observations."""
        return any(x is not None for x in (self.since, self.until, self.user_id, self.session_id))


def trace_conditions(f: TraceFilter) -> list[Column]:
    """Conditions on a trace's own columns."""
    out = []
    for name in ("project_id", "user_id", "session_id", "environment"):
        if getattr(f, name):
            out.append(F.col(name) == getattr(f, name))
    if f.since is not None:
        out.append(F.col("timestamp") >= F.lit(f.since))
    if f.until is not None:
        out.append(F.col("timestamp") <= F.lit(f.until))
    if f.tags:
        out.append(F.size(F.array_except(F.array(*map(F.lit, f.tags)), F.col("tags"))) == 0)
    if f.metadata and all(f.metadata):
        out.append(F.coalesce(F.try_element_at("metadata", F.lit(f.metadata[0])) == f.metadata[1], F.lit(False)))
    return out


def has_text(column: str, text: str) -> Column:
    """Literal, case-insensitive substring; % and _ mean themselves."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(text))), F.lit(False))


def _where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def scoped(observations: DataFrame, traces: DataFrame) -> DataFrame:
    """Observations of the given traces only, before versions collapse: trace_id is part of the key."""
    ids = traces.select("project_id", F.col("id").alias("trace_id")).distinct()
    return observations.join(ids, ["project_id", "trace_id"], "left_semi")


def possible(observations: DataFrame, condition: Column) -> DataFrame:
    """Observations of traces that have any version for which the condition holds, so that only these are ranked: no
    other trace can have a live one. The first look reads three columns, and the condition reaches the scan."""
    key = ["project_id", "trace_id"]
    return observations.join(observations.where(condition).select(*key).distinct(), key, "left_semi")


def whole_days(traces: DataFrame, f: TraceFilter) -> DataFrame:
    """All versions of the days that the range touches. The day is part of the key, so this may come before
    versions collapse, and it reaches the scan."""
    if f.since is not None:
        traces = traces.where(F.col("timestamp") >= F.lit(f.since.replace(hour=0, minute=0, second=0, microsecond=0)))
    if f.until is not None:
        traces = traces.where(F.col("timestamp") < F.lit(f.until.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)))
    return traces


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _any(column: str, value: str) -> str:
    return f"_{column}={value}"


def _facts(observations: DataFrame, filters: list[TraceFilter]) -> DataFrame:
    """What the filters ask of a trace's live observations (figured), a row per trace, all from one pass."""
    asked = {_any(c, getattr(f, c)): F.bool_or(F.col(c) == getattr(f, c)) for f in filters for c in ("level", "model") if getattr(f, c)}
    if any(f.min_duration_ms is not None for f in filters):
        asked["_ms"] = duration_ms(F.min("start_time"), F.max("end_time"))
    if any(f.min_cost is not None for f in filters):
        asked["_cost"] = F.sum("cost")
    if any(f.settled_before is not None for f in filters):
        asked["_version"] = F.max("event_ts")
    for text in {f.search for f in filters if f.search}:
        asked[_any("search", text)] = F.bool_or(_own_text(text))
    return observations.groupBy("project_id", "trace_id").agg(*[c.alias(n) for n, c in asked.items()])


def _of_observations(f: TraceFilter) -> list[Column]:
    """Conditions on ``_facts`` that a trace without observations never meets."""
    out = [F.col(f"`{_any(c, getattr(f, c))}`") for c in ("level", "model") if getattr(f, c)]
    if f.min_duration_ms is not None:
        out.append(F.col("_ms") >= f.min_duration_ms)
    if f.min_cost is not None:
        out.append(F.col("_cost") >= F.lit(str(f.min_cost)).cast("decimal(28,9)"))
    return out


def _own_text(text: str) -> Column:
    return has_text("name", text) | has_text("input", text) | has_text("output", text)


def counted(traces: DataFrame, observations: DataFrame, filters: dict[str, TraceFilter]) -> DataFrame:
    """(filter, traces): how many live traces each of the named filters matches, as long as its list. Takes all versions;
    each table is read and ranked once for all filters, by the few columns that they ask for."""
    asked = list(filters.values())
    if not asked:
        raise ValueError("no filters")
    own = [_all(trace_conditions(f)) & (((F.col("id") == f.search) | _own_text(f.search)) if f.search else F.lit(True)) for f in asked]
    narrow = [_all(trace_conditions(f)) for f in asked]
    flags = {f"_own{i}": c for i, c in enumerate(own)} | {f"_may{i}": c for i, (f, c) in enumerate(zip(asked, narrow, strict=True)) if f.search}
    live = latest(traces.select("project_id", "id", "timestamp", "event_ts", "is_deleted", "seq", *[c.alias(n) for n, c in flags.items()]), "traces")
    version = F.lit(None).cast("timestamp")
    if any(f.settled_before is not None for f in asked):  # live rows of any day count for a trace's version
        live = live.withColumn("_newest", F.max("event_ts").over(W.partitionBy("project_id", "id")))
        version = F.greatest("_newest", "_version")
    if any(f.search or f.settled_before is not None or _of_observations(f) for f in asked):
        facts = _facts(latest(figured(observations), "observations"), asked).withColumnRenamed("trace_id", "id")
        live = live.join(facts, ["project_id", "id"], "left")
    counts = []
    for i, (name, f) in enumerate(filters.items()):
        fits = F.col(f"_own{i}")
        if f.search:
            fits = fits | (F.col(f"_may{i}") & F.coalesce(F.col(f"`{_any('search', f.search)}`"), F.lit(False)))
        settled = [] if f.settled_before is None else [version <= F.lit(f.settled_before)]
        counts.append(F.struct(F.lit(name).alias("filter"), F.count_if(_all([fits, *_of_observations(f), *settled])).alias("traces")))
    return live.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def matched(traces: DataFrame, observations: DataFrame, f: TraceFilter, scope: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Live traces that match, and the live observations that may count for them. Takes all versions.

    ``scope`` says whether observations are limited to traces that meet the trace conditions before
    their versions collapse; by default if the filter narrows by time, user or session."""
    if f.project_id:
        traces, observations = (d.where(F.col("project_id") == f.project_id) for d in (traces, observations))
    live = _where(latest(whole_days(traces, f), "traces"), trace_conditions(f))
    if f.narrows if scope is None else scope:
        observations = scoped(observations, live)
    if f.model:
        observations = possible(observations, F.col("model") == f.model)
    seen = latest(observations, "observations")
    key = ["project_id", "id"]
    of = seen.withColumnRenamed("id", "observation_id").withColumnRenamed("trace_id", "id")
    if f.search:
        hits = of.where(_own_text(f.search)).select(*key).distinct()
        marked = live.join(hits.withColumn("_hit", F.lit(True)), key, "left")
        live = marked.where((F.col("id") == f.search) | _own_text(f.search) | F.col("_hit").isNotNull()).drop("_hit")
    wanted = _of_observations(f)
    if wanted:
        slim = latest(figured(observations), "observations")
        live = live.join(_facts(slim, [f]).where(_all(wanted)).select("project_id", F.col("trace_id").alias("id")), key, "left_semi")
    if f.settled_before is not None:
        from spanloom.operators.settlement import activity

        quiet = activity(traces, observations).where(F.col("version") <= F.lit(f.settled_before))
        live = live.join(quiet.select("project_id", F.col("trace_id").alias("id")), key, "left_semi")
    return live, seen


def matches_destination(f: TraceFilter) -> Column:
    """The condition of an export or forward: as for lists, but by trace columns alone and never by
    environment."""
    conditions = trace_conditions(TraceFilter(project_id=f.project_id, since=f.since, until=f.until, user_id=f.user_id, session_id=f.session_id, tags=f.tags, metadata=f.metadata))
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def imported(tags: Column) -> Column:
    """Whether the trace carries an importer's tag."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in IMPORT_TAGS])), F.lit(False))


#: Tags that importers set.
IMPORT_TAGS = ("imported:langfuse", "imported:langsmith")
