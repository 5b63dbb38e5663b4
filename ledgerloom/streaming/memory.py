"""The memory of counterparties as keyed state of a stream.

Rows of an entity meet in the state of its key: what earlier runs knew of it (the initial state), else its first confirming row.
Later rows take that; rows before it keep their own evidence, as a stream cannot fill back. The state also holds the
memory record itself, so that a batch can read it from the checkpoint. Rows without an entity, and transfers between own
accounts, need no state and pass beside it.

A key's rows of one micro-batch are put in order in one task, as columns, so a micro-batch is as large as the source's rate limit
lets it be. Nothing else grows with an entity: its state is two short records, and outcomes leave in parts of CHUNK rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import transfers as T_
from ..sources.tables import month_key

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = [c.split() for c in T_.MEMORY.split(", ")]
RECORD = ", ".join(" ".join(f) for f in FIELDS[1:])
CHUNK = 10_000
KNOWN = "category string, confidence double, evidence_type string, month string, old boolean"
OUTCOME = {"state": "string", "evidence_type": "string", "match_source": "string", "category_area": "string", "confidence": "double", "fuzzy_match_term": "string", "fuzzy_match_score": "double"}


def months_between(first: str | None, last: str | None) -> int:
    """Whole months from yyyy-MM to yyyy-MM; 0 if one is no month."""
    try:
        (a, b), (c, d) = (map(int, m.split("-")) for m in (first, last))
    except (AttributeError, ValueError):
        return 0
    return 12 * (c - a) + d - b


def _records(frame):
    """Rows of a frame as dictionaries, one at a time; what is missing is None."""
    names = list(frame.columns)
    for values in frame.itertuples(index=False, name=None):
        yield {n: None if v != v else v for n, v in zip(names, values)}


class EntityMemory(StatefulProcessor):
    """One entity: ``known`` is what its rows are told, ``memory`` the record that is kept for later runs."""

    def __init__(self, place: str, forget_after: int | None, idle_ms: int | None):
        self.place, self.forget_after, self.idle_ms = place, forget_after, idle_ms

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", f"{KNOWN}, {self.place}", self.idle_ms)
        self.memory = handle.getValueState("memory", RECORD, self.idle_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        # Of several records of an entity the earliest counts.
        order = lambda r: tuple((v is not None, v) for v in (r["first_seen"], r["last_seen"], r["category"], r["confidence"], r["evidence_type"]))
        for r in _records(initialState):
            if not self.known.exists() or order(r) < order(dict(zip([n for n, _ in FIELDS[1:]], self.memory.get()))):
                self.known.update((r["category"], r["confidence"], r["evidence_type"], r["last_seen"], True, None, None))
                self.memory.update(tuple(int(r[n]) if kind == "int" and r[n] is not None else r[n] for n, kind in FIELDS[1:]))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows), ignore_index=True).sort_values(["doc_id", "seq"], ignore_index=True)
        names = ["doc_id", "seq", "txn_type", "entity_key", *OUTCOME]
        known = self.known.get() if self.known.exists() else None
        memory = self.memory.get() if self.memory.exists() else None
        out = []
        for r in _records(frame):
            place = (r["doc_id"], r["seq"])
            if known and self.forget_after is not None and months_between(known[3], r["month"]) > self.forget_after:
                known = memory = None
            if known and (known[4] or place > known[5:]):
                told = ("confirmed", known[2] or "entity_memory", "entity_memory", known[0] or r["category_area"] or "Unknown", max(r["confidence"] or 0.0, 0.95 if known[1] is None else known[1]), None, None)
            else:
                told = tuple(r[f"own_{c}"] for c in OUTCOME)
            learned = r["own_state"] == "confirmed" and (known is None or known[4] and known[5] is None or place < known[5:])
            if learned:
                # An entity that earlier runs knew keeps what they told of it, but its record is renewed once.
                known = (*known[:5], *place) if known and known[4] else (r["own_category_area"], r["kept"], r["own_evidence_type"], r["month"], False, *place)
                memory = self._renewed(memory, r)
            out.append((*place, r["txn_type"], key[0], *told))
            if len(out) == CHUNK:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)
        if known:
            self.known.update(known)
            self.memory.update(memory)
        else:
            self.known.clear()
            self.memory.clear()

    def _renewed(self, memory, r) -> tuple:
        first, last, months = (memory[4], memory[5], memory[6] or 0) if memory else (None, None, 0)
        months += r["month"] != last
        return (r["name"], r["own_category_area"], r["kept"], "confirmed", first or r["month"], r["month"], months, r["own_evidence_type"])

    def close(self) -> None:
        pass


def remembered(stream: DataFrame, memory: DataFrame | None = None, forget_after: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """doc_id, seq, txn_type, entity_key and the outcome of each transfer of a stream of classified rows.

    memory: records of earlier runs (columns of MEMORY). forget_after: months after which a row finds nothing of an
    entity's last record. idle_ms: milliseconds after which an entity that no row names leaves the state (state time to live); such a
    stream needs a trigger that goes on, as state that waits for the clock never lets ``availableNow`` end. Rows should come in the
    order of documents; within a micro-batch their order does not matter.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = T_.own_evidence(T_.counterparties(stream), fuzzy=False)
    own = F.col("__own")
    values = {"state": own["state"], "evidence_type": own["evidence_type"], "match_source": own["match_source"], "category_area": own["category_area"], "confidence": own["confidence"], "fuzzy_match_term": own["term"], "fuzzy_match_score": own["score"]}
    active = F.col("txn_type").isin("external_transfer", "salary_income")
    keyed = active & F.col("entity_key").isNotNull()
    name = F.coalesce("recipient_name", F.when(F.col("txn_type") == "salary_income", "salary_income").otherwise(own["term"]))
    state = rows.filter(keyed).select(
        "doc_id", "seq", "txn_type", "entity_key", "category_area", "confidence", name.alias("name"), month_key(F.col("booking_date")).alias("month"), F.bround(own["remembered"], 4).alias("kept"), *[c.alias(f"own_{n}") for n, c in values.items()]
    )
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    place = f"doc {kinds['doc_id'].simpleString()}, row {kinds['seq'].simpleString()}"
    out = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("seq", kinds["seq"]), T.StructField("txn_type", T.StringType()), T.StructField("entity_key", T.StringType())])
    for n, kind in OUTCOME.items():
        out = out.add(n, kind)
    mode = "none" if idle_ms is None else "processingTime"
    told = state.groupBy("entity_key").transformWithStateInPandas(EntityMemory(place, forget_after, idle_ms), out, "append", mode, memory.groupBy("entity_key") if memory is not None else None)
    internal = F.col("txn_type") == "internal_transfer"
    fixed = {"state": "excluded", "evidence_type": "internal_transfer_filter", "match_source": "internal_transfer_filter", "category_area": F.col("category_area"), "confidence": F.col("confidence")}
    beside = [F.when(internal, fixed[n] if n in fixed else F.lit(None)).otherwise(values[n]).cast(kind).alias(n) for n, kind in OUTCOME.items()]
    rest = rows.filter(F.col("txn_type").isin(T_.TRANSFER_TYPES) & ~F.coalesce(keyed, F.lit(False))).select("doc_id", "seq", "txn_type", "entity_key", *beside)
    return told.unionByName(rest)


def memory_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The memory records in the state of a stream, read from its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "memory").load()
    return state.select(F.col("key.*"), "value.*").toDF(*[n for n, _ in FIELDS])
