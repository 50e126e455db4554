"""Lazy wiring of every layer from the given tables.

Each name is a DataFrame built on first use. Staging, history, facts and marts are written
once as parquet tables under the shared checkpoint folder, so that later layers start from
files: true sizes, pruned columns, short plans, and nothing recomputed when an executor is
lost. Reference dimensions and the calendar are stored too, so their sizes decide on broadcasts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import spread
from tidemark.functions.ordered import HOT_ROWS, lagged, position, running
from tidemark.operators import defects, dimensions, facts, history, incidents, marts, monitoring, staging
from tidemark.session import checkpoint_dir
from tidemark.sources.damage import (
    BASELINE,
    CHECKPOINTS,
    DAMAGED,
    JSON_LINES,
    MODEL_CATALOGUE,
    OUTBOX,
    REPEATED,
    SHARED_EMAIL,
    SNAPSHOTS,
    damaged_dirty,
)
from tidemark.sources.feed import CHANGES, FEEDS
from tidemark.sources.tables import TABLE_DDL, read_table

#: Tables built at the same time where they do not depend on each other.
PARALLEL_TABLES = 4
#: Seed and horizon of the defect drill.
SEED, DEFECT_HORIZON = 42, "2024-02-01 00:00:00"
#: Times of the two snapshot runs.
SNAPSHOT_RUNS = ("2024-01-10 00:00:00", "2024-01-31 00:00:00")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


class once:
    """Property computed on first use, also when several threads ask for it."""

    def __init__(self, build: Callable[[Lake], object]):
        self.build, self.name = build, build.__name__

    def __get__(self, lake: Lake | None, owner: type):
        if lake is None:
            return self
        return lake._once(f"once.{self.name}", lambda: self.make(lake))

    def make(self, lake: Lake) -> object:
        return self.build(lake)


class stored(once):
    """Property whose DataFrame is written as a table on first use and read back."""

    def make(self, lake: Lake) -> DataFrame:
        return lake.store(self.name, self.build(lake))


class Lake:
    """Named tables of all layers over one directory of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.hot_rows = hot_rows
        self._memo: dict[str, DataFrame] = {}
        self._locks: dict[str, RLock] = {}

    @once
    def root(self) -> str:
        return f"{checkpoint_dir(self.spark)}/tidemark-{uuid.uuid4().hex}"

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table into the shared folder and return it as a scan."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str) -> DataFrame:
        return self._once(f"table.{name}", lambda: read_table(self.spark, self.sf_dir, name))

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        # Tables form a tree of dependencies, so waiting for one another cannot deadlock.
        with self._locks.setdefault(name, RLock()):
            if name not in self._memo:
                self._memo[name] = build()
            return self._memo[name]

    def together(self, names: Mapping[str, str]) -> dict[str, DataFrame]:
        """Several independent tables, their jobs submitted at the same time."""
        with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
            built = pool.map(lambda attribute: getattr(self, attribute), names.values())
            return dict(zip(names, built))

    def _source(self, name: str) -> DataFrame:
        if name == "numbered":
            views = self.table("events").filter(F.col("event_type").isin("view", "click"))
            return running(
                views.withColumn("__day", F.to_date("ts")), ["user_id", "__day"],
                ["ts", "event_id"], [position()], self.hot_rows,
            )
        if name == "chained":
            changes = self.spark.sql(CHANGES, events=self.table("events"))
            return running(
                changes, ["user_id", "field_name"], ["ts", "event_id"],
                [lagged("prior_value", F.col("new_value"))], self.hot_rows,
            )
        if name in ("lineitem", "orders", "events"):
            return self._once(f"spread.{name}", lambda: spread(self.table(name)))
        return self.table(name)

    def _feed(self, entity: str) -> DataFrame:
        feed = FEEDS[entity]
        names = [n for n in (*TABLE_DDL, "numbered", "chained") if "{" + n + "}" in feed.sql]
        return self.spark.sql(feed.sql, **{n: self._source(n) for n in names})

    def raw(self, entity: str) -> DataFrame:
        """Rows of a feed without entity typing (job runs, tasks, check events)."""
        return self._once(f"raw.{entity}", lambda: self._feed(entity))

    def clean(self, entity: str) -> DataFrame:
        """Physical rows before replays are added."""

        def build() -> DataFrame:
            physical = self._physical(self._feed(entity), entity)
            return self.store(f"clean_{entity}", physical) if self._ordered(entity) else physical

        return self._once(f"clean.{entity}", build)

    @staticmethod
    def _ordered(entity: str) -> bool:
        """Entities whose derivation needs an ordered scan land as tables."""
        return any(name in FEEDS[entity].sql for name in ("{numbered}", "{chained}"))

    def bronze(self, entity: str) -> DataFrame:
        """Physical rows, replays included."""

        def build() -> DataFrame:
            rows, feed = self._feed(entity), FEEDS[entity]
            if feed.replay:
                # One scan: the replay is a second element of an exploded array.
                delays = F.when(
                    F.expr(feed.replay), F.array(F.expr("interval '0' hour"), F.expr(feed.delay))
                ).otherwise(F.array(F.expr("interval '0' hour")))
                rows = rows.withColumn("__delay", F.explode(delays)).withColumn(
                    "ingested_at", F.col("ingested_at") + F.col("__delay")
                )
            physical = self._physical(rows, entity)
            if self._ordered(entity):
                return self.store(f"bronze_{entity}", physical)
            return physical

        return self._once(f"bronze.{entity}", build)

    @staticmethod
    def _physical(rows: DataFrame, entity: str) -> DataFrame:
        if "dt" not in rows.columns:
            rows = rows.withColumn("dt", F.to_date("ingested_at"))
        return rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name)
              for f in schemas.entity_schema(entity).fields]
        )

    # staging -------------------------------------------------------------------------

    @cached_property
    def stg_models(self) -> DataFrame:
        return staging.stg_models(self.bronze("models"))

    @cached_property
    def stg_devices(self) -> DataFrame:
        return staging.stg_devices(self.bronze("devices"))

    @cached_property
    def stg_plans(self) -> DataFrame:
        return staging.stg_subscription_plans(self.bronze("subscription_plans"))

    @stored
    def stg_users(self) -> DataFrame:
        return staging.stg_users(self.bronze("users"))

    @stored
    def stg_user_updates(self) -> DataFrame:
        return staging.stg_user_updates(self.bronze("user_updates"))

    @stored
    def stg_conversations(self) -> DataFrame:
        return staging.stg_conversations(self.bronze("conversations"))

    @stored
    def stg_messages(self) -> DataFrame:
        return staging.stg_messages(self.bronze("messages"), self.stg_conversations)

    @stored
    def stg_completions(self) -> DataFrame:
        return staging.stg_completions(self.bronze("completions"), self.stg_messages)

    @stored
    def stg_inferences(self) -> DataFrame:
        return staging.stg_model_inferences(self.bronze("model_inferences"))

    @stored
    def stg_feedback(self) -> DataFrame:
        return staging.stg_feedback(self.bronze("feedback"))

    @stored
    def stg_errors(self) -> DataFrame:
        return staging.stg_errors(self.bronze("errors"))

    @stored
    def stg_subscriptions(self) -> DataFrame:
        return staging.stg_subscriptions(self.bronze("subscriptions"))

    @stored
    def stg_purchases(self) -> DataFrame:
        return staging.stg_purchases(self.bronze("purchases"))

    @stored
    def stg_payments(self) -> DataFrame:
        return staging.stg_payments(self.bronze("payments"), self.stg_purchases)

    # history -------------------------------------------------------------------------

    def state_at(self, run_at: str) -> DataFrame:
        """Current user state as it stood at a snapshot run."""
        return history.current_user_state(
            self.stg_users.filter(F.col("signup_at") < at(run_at)),
            self.stg_user_updates.filter(F.col("updated_at") < at(run_at)),
        )

    @stored
    def current_user_state(self) -> DataFrame:
        return history.current_user_state(self.stg_users, self.stg_user_updates)

    @stored
    def user_state_history(self) -> DataFrame:
        return history.user_state_history(self.stg_users, self.stg_user_updates, self.hot_rows)

    @stored
    def user_snapshot(self) -> DataFrame:
        first, second = SNAPSHOT_RUNS
        earlier = history.scd2_snapshot(None, self.state_at(first), at(first))
        return history.scd2_snapshot(earlier, self.current_user_state, at(second))

    @stored
    def dim_user(self) -> DataFrame:
        return history.dim_user(
            self.user_state_history, self.user_snapshot, self.current_user_state
        )

    @cached_property
    def dim_user_sensitive(self) -> DataFrame:
        return history.dim_user_sensitive(self.dim_user, self.current_user_state)

    # dimensions ----------------------------------------------------------------------

    # Stored, so that the planner knows their sizes and broadcasts those within its limit.

    @stored
    def dim_date(self) -> DataFrame:
        return dimensions.dim_date(
            self.stg_models, self.current_user_state, self.stg_subscriptions, self.user_snapshot)

    @stored
    def dim_device(self) -> DataFrame:
        return dimensions.dim_device(self.stg_devices)

    @stored
    def dim_model(self) -> DataFrame:
        return dimensions.dim_model(self.stg_models)

    @stored
    def dim_plan(self) -> DataFrame:
        return dimensions.dim_subscription_plan(self.stg_plans)

    # facts ---------------------------------------------------------------------------

    @once
    def disjoint_versions(self) -> bool:
        """Whether no two versions of a user overlap; read once from the dimension."""
        return facts.disjoint(self.dim_user, "user_id", hot_rows=self.hot_rows)

    def lookups(self) -> None:
        """Build what every fact looks up, before facts are built together."""
        self.together({n: n for n in ("stg_users", "stg_user_updates", "stg_subscriptions")})
        self.together({n: n for n in ("current_user_state", "user_state_history", "user_snapshot")})
        self.dim_user
        self.together({n: n for n in ("dim_date", "disjoint_versions", "dim_device", "dim_model",
                                      "dim_plan")})

    @stored
    def fact_conversation(self) -> DataFrame:
        return facts.fact_conversation(
            self.stg_conversations, self.dim_user, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_message(self) -> DataFrame:
        return facts.fact_message(
            self.stg_messages, self.dim_user, self.dim_device, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_completion(self) -> DataFrame:
        return facts.fact_completion(
            self.stg_completions, self.dim_user, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_inference(self) -> DataFrame:
        return facts.fact_model_inference(
            self.stg_inferences, self.dim_user, self.dim_model, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_feedback(self) -> DataFrame:
        return facts.fact_feedback(self.stg_feedback, self.dim_user, self.dim_date, self.hot_rows, self.disjoint_versions)

    @stored
    def fact_error(self) -> DataFrame:
        return facts.fact_error(
            self.stg_errors, self.dim_user, self.dim_model, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_subscription(self) -> DataFrame:
        return facts.fact_subscription(
            self.stg_subscriptions, self.dim_user, self.dim_plan, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_purchase(self) -> DataFrame:
        return facts.fact_purchase(
            self.stg_purchases, self.dim_user, self.dim_plan, self.dim_date, self.hot_rows,
            self.disjoint_versions,
        )

    @stored
    def fact_payment(self) -> DataFrame:
        return facts.fact_payment(self.stg_payments, self.dim_user, self.dim_date, self.hot_rows, self.disjoint_versions)

    # marts ---------------------------------------------------------------------------

    @stored
    def gold_product(self) -> DataFrame:
        self.lookups()
        self.together({n: n for n in (
            "fact_message", "fact_conversation", "fact_completion", "fact_feedback")})
        return marts.product_daily(
            self.fact_message, self.fact_conversation, self.fact_completion, self.fact_feedback,
            self.dim_date,
        )

    @stored
    def gold_user_activity(self) -> DataFrame:
        self.lookups()
        self.together({n: n for n in (
            "fact_message", "fact_conversation", "fact_completion", "fact_feedback",
            "fact_inference")})
        return marts.user_activity_daily(
            self.fact_message, self.fact_conversation, self.fact_completion, self.fact_feedback,
            self.fact_inference, self.dim_date,
        )

    @stored
    def gold_ml(self) -> DataFrame:
        return marts.model_daily(self.fact_inference, self.dim_date, self.dim_model)

    @stored
    def gold_finance(self) -> DataFrame:
        self.lookups()
        self.together({n: n for n in ("fact_payment", "fact_purchase", "fact_subscription")})
        return marts.finance_daily(
            self.fact_subscription, self.fact_purchase, self.fact_payment, self.dim_date
        )

    # monitoring ----------------------------------------------------------------------

    @cached_property
    def facts(self) -> dict[str, DataFrame]:
        """The nine facts by entity name."""
        return self.facts_of(list(FACT_TABLES))

    def facts_of(self, entities: Sequence[str]) -> dict[str, DataFrame]:
        """Some of the facts by entity name, built together."""
        self.lookups()
        return self.together({e: FACT_TABLES[e] for e in entities})

    @cached_property
    def stagings(self) -> dict[str, DataFrame]:
        """The staging table behind each fact."""
        return self.together(STAGING_TABLES)

    @cached_property
    def golds(self) -> dict[str, DataFrame]:
        self.facts
        return self.together({
            "product": "gold_product",
            "user_activity": "gold_user_activity",
            "ml": "gold_ml",
            "finance": "gold_finance",
        })

    @stored
    def dq_freshness(self) -> DataFrame:
        return monitoring.freshness(self.facts)

    @stored
    def dq_volume(self) -> DataFrame:
        return monitoring.volume(self.facts, self.dim_date, 0.10)

    @stored
    def dq_quality(self) -> DataFrame:
        return monitoring.quality(self.facts_of(TESTED), self.dim_date)

    @stored
    def dq_reconciliation(self) -> DataFrame:
        self.facts
        marts = self.together({m: f"gold_{m}" for m in sorted({m for m, _ in monitoring.FACT_TO_MART.values()})})
        return monitoring.pipeline_reconciliation(self.stagings, self.facts, marts)

    @cached_property
    def checks(self) -> DataFrame:
        self.facts
        t = self.together({n: n for n in ("dq_freshness", "dq_volume", "dq_quality", "dq_reconciliation")})
        return monitoring.check_rows(
            t["dq_freshness"], t["dq_volume"], t["dq_quality"], t["dq_reconciliation"]
        )

    def damaged(self, name: str) -> DataFrame:
        """Copy of a derived table with planted faults, the input of the assertions."""
        text = DAMAGED[name]
        (source,) = {part.split("}")[0] for part in text.split("{")[1:]}
        return self._once(name, lambda: self.spark.sql(text, **{source: getattr(self, source)}))

    # validator inputs ----------------------------------------------------------------

    @cached_property
    def closed(self) -> DataFrame:
        return history.closed_times(self.stg_users, self.stg_user_updates)

    @cached_property
    def users_with_shared_email(self) -> DataFrame:
        return self.spark.sql(SHARED_EMAIL, stg_users=self.stg_users)

    @cached_property
    def model_catalogue(self) -> DataFrame:
        return self.spark.sql(MODEL_CATALOGUE, part=self.table("part"))

    # defects -------------------------------------------------------------------------

    def unique_parents(self, entity: str) -> bool:
        """Whether no two parent rows of a defect plan share their key; read once."""
        parent, key, _ = defects.PARENTS[entity]

        def build() -> bool:
            ids = self.clean(parent).filter(F.col(key).isNotNull())
            return ids.groupBy(key).count().filter("count > 1").isEmpty()

        return self._once(f"unique_parents.{entity}", build)

    def labelled(self, entity: str) -> DataFrame:
        """Clean rows with the defect each one would receive.

        Labels come from a row's own id, so only rows that are to be shifted in time look up their
        parent and are stored. Parents with repeated keys, a data fault, are joined to all rows.
        """

        def build() -> DataFrame:
            rows = self.clean(entity)
            if entity in defects.PARENTS:
                parent, key, parent_at = defects.PARENTS[entity]
                due = defects.shifted(entity) if self.unique_parents(entity) else None
                rows = defects.drawn(rows, entity, SEED)
                rows = defects.with_parent_time(
                    rows, self.clean(parent), key, parent_at, due,
                    lambda joined: self.store(f"parents_of_{entity}", joined))
            return defects.label(rows, entity, SEED, DEFECT_HORIZON)

        return self._once(f"labelled.{entity}", build)

    def before_defects(self, entity: str) -> DataFrame:
        """Clean rows as the defects find them."""
        return self.clean(entity).select(*schemas.entity_columns(entity), "ingested_at")

    def dirty(self, entity: str) -> DataFrame:
        return defects.dirty_rows(self.labelled(entity), entity)

    def log(self, entity: str) -> DataFrame:
        return defects.manifest(self.labelled(entity), entity, SEED)

    @stored
    def defect_log(self) -> DataFrame:
        return monitoring.union_all([self.log(e) for e in defects.PLANS])

    def damaged_dirty(self, entity: str) -> DataFrame:
        text = damaged_dirty(entity, schemas.entity_columns(entity), schemas.ENTITY_ID[entity], "{dirty}")
        return self.spark.sql(text, dirty=self.dirty(entity))

    @cached_property
    def json_lines(self) -> DataFrame:
        return self.spark.sql(JSON_LINES, events=self.table("events"))

    # incidents -----------------------------------------------------------------------

    @stored
    def observations(self) -> DataFrame:
        """Observation stream of the check events; ids are stable hashes."""
        raw = self.raw("check_events")
        status = monitoring.normalise_status(F.col("raw_status"))
        digest = incidents.fingerprint(F.col("source"), F.col("category"), [F.col("check_name")])
        return raw.withColumn("fingerprint", digest).select(
            "source", "category", "check_name", "fingerprint",
            status.alias("status"), "observed_at",
            incidents.observation_id(F.col("fingerprint"), incidents.json_string(F.col("observation_id").cast("string"))).alias("observation_id"),
        )

    def cut(self, df: DataFrame) -> DataFrame:
        """Write an intermediate table and continue from its files."""
        return self.store(f"cut_{uuid.uuid4().hex}", df)

    @stored
    def decisions(self) -> DataFrame:
        return incidents.decide(self.observations, self.hot_rows, self.cut, self.outages)

    @stored
    def outages(self) -> DataFrame:
        return incidents.source_outages(self.observations)

    @cached_property
    def repeated_observations(self) -> DataFrame:
        """Observations with some delivered twice; ``arrival`` numbers the deliveries."""
        return self.spark.sql(REPEATED, observations=self.observations)

    @cached_property
    def repeated_decisions(self) -> DataFrame:
        return incidents.decide(self.repeated_observations, self.hot_rows, self.cut, self.outages)

    @cached_property
    def baseline_observations(self) -> DataFrame:
        return self.spark.sql(BASELINE, repeated=self.repeated_observations)

    @cached_property
    def baseline_decisions(self) -> DataFrame:
        """A quiet first batch hands its open incidents over to the rows after it."""
        return incidents.decide(self.baseline_observations, self.hot_rows, self.cut, self.outages)

    @stored
    def outbox(self) -> DataFrame:
        return self.spark.sql(
            OUTBOX, notifications=incidents.notifications(self.decisions, self.hot_rows)
        )

    @stored
    def outbox_checkpoints(self) -> DataFrame:
        return self.spark.sql(CHECKPOINTS, notifications=self.outbox)

    @cached_property
    def run_snapshots(self) -> DataFrame:
        return self.spark.sql(SNAPSHOTS, job_runs=self.raw("job_runs"))

    # narrow tables -------------------------------------------------------------------

    @cached_property
    def monitored(self) -> Narrow:
        """The lake with the columns that the monitoring checks read."""
        return self.narrowed(monitored_columns())

    def narrowed(self, columns: Mapping[str, Sequence[str]]) -> Narrow:
        """This lake with only the named columns of the named tables."""
        return Narrow(self, columns)


#: Fact table and staging table of each entity.
FACT_TABLES = {
    "payments": "fact_payment", "purchases": "fact_purchase", "messages": "fact_message",
    "completions": "fact_completion", "model_inferences": "fact_inference",
    "conversations": "fact_conversation", "feedback": "fact_feedback", "errors": "fact_error",
    "subscriptions": "fact_subscription",
}

STAGING_TABLES = {
    "payments": "stg_payments", "purchases": "stg_purchases", "messages": "stg_messages",
    "completions": "stg_completions", "model_inferences": "stg_inferences",
    "conversations": "stg_conversations", "feedback": "stg_feedback", "errors": "stg_errors",
    "subscriptions": "stg_subscriptions",
}


# What the rates test.
TESTED = {
    "messages": ["is_message_text_missing", "is_timestamp_order_valid", "user_id", "user_key",
                 "device_id", "device_key"],
    "completions": ["is_timestamp_order_valid", "is_user_id_recovered", "completion_status"],
    "model_inferences": ["is_model_id_missing", "is_timestamp_order_valid", "inference_status"],
    "feedback": ["is_feedback_type_missing"],
    "purchases": ["is_purchase_type_missing"],
    "payments": ["is_payment_method_missing", "is_timestamp_order_valid", "payment_status"],
}
#: Columns of the facts that daily counts read, and those that the rates read.
COUNTED_COLUMNS = {t: ["date_key"] for t in FACT_TABLES.values()}
RATE_COLUMNS = {FACT_TABLES[e]: ["date_key", *columns] for e, columns in TESTED.items()}


def monitored_columns(rates: bool = True, totals: bool = True) -> dict[str, list[str]]:
    """Columns of each fact that freshness, rates and daily counts, and mart totals read."""
    # What the marts group or date their counts by.
    grouped = {"model_inferences": ["model_key", "model_id"], "subscriptions": ["ended_at"]}
    out = {}
    for entity, at_column in monitoring.MONITORED.items():
        columns = [at_column, "ingested_at", "source_partition_date"]
        columns += ["date_key"] if rates or totals else []
        columns += TESTED.get(entity, []) if rates else []
        columns += grouped.get(entity, []) if totals else []
        out[FACT_TABLES[entity]] = columns
    # The only lookups of whole rows: parents' times, and the user of a completion.
    if rates:
        out["stg_payments"] = ["payment_id", "user_id", "processed_at", "ingested_at",
                               "physical_partition_date", "is_payment_method_missing",
                               "is_timestamp_order_valid", "payment_status"]
        out["stg_messages"] = ["message_id", "conversation_id", "user_id", "device_id", "created_at", "ingested_at",
                               "physical_partition_date", "is_message_text_missing", "is_timestamp_order_valid"]
    return out


#: Tables with rows of whole facts behind them; a narrow lake has its own.
WIDE = ("fact_", "gold_", "dq_", "damaged_")
WIDE_STAGING = frozenset(f"stg_{e}" for e in (
    "conversations", "messages", "completions", "inferences", "feedback", "errors", "purchases",
    "payments"))


class Narrow(Lake):
    """Facts and what follows from them with the columns one query needs.

    Named tables are stored with their named columns; reading one of the others fails the job. Other
    staging and mart tables stay plans, so that unused columns, and the lookups behind them, fall away
    before anything is shuffled. All else, and tables that are there in full, come from the whole lake.
    """

    def __init__(self, whole: Lake, columns: Mapping[str, Sequence[str]]):
        super().__init__(whole.spark, whole.sf_dir, whole.hot_rows)
        self.whole = whole
        self.columns = columns

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        table = name.removeprefix("once.")
        if name not in self.whole._memo and (table.startswith(WIDE) or table in WIDE_STAGING):
            return super()._once(name, build)
        return self.whole._once(name, build)

    def store(self, name: str, df: DataFrame) -> DataFrame:
        # Other lakes under the same root have tables of this name.
        path = f"{name}_{uuid.uuid4().hex}"
        if name in self.columns:
            kept = super().store(path, df.select(*self.columns[name]))
            return kept.select(*[
                F.col(f.name) if f.name in kept.columns
                else F.raise_error(F.lit(f"{name}.{f.name} was not kept")).cast(f.dataType).alias(f.name)
                for f in df.schema.fields])
        if name in WIDE_STAGING or name.startswith("gold_"):
            return df
        return super().store(path, df)
