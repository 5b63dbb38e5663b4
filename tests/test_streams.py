"""Streams with state: memory of entities over a restart, repeated rows and both sides of a transfer, late ones too."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup as D
from ledgerloom.operators import transfers as T
from ledgerloom.sources import grammar as G
from ledgerloom.streaming import duplicates as SD
from ledgerloom.streaming import memory as SM

ROW = "doc_id long, seq long, txn_type string, raw_description string, booking_date string, category_area string, confidence double"
OUT = ["seq", "state", "evidence_type", "match_source", "category_area", "confidence", "fuzzy_match_term", "fuzzy_match_score"]


def external(doc, seq, text, date="05/01/2027", kind="external_transfer"):
    return (doc, seq, kind, text, date, None, 0.93)


def run(stream, path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()


def batches(spark, path, schema, rows, files=10):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


ENTITY = [
    external(1, 1, "PLATA INSTANT; Casa Verde"),
    external(1, 2, "PLATA INSTANT; Casa Verde; lease"),
    external(1, 3, "PLATA INSTANT; Casa Verde"),
    external(1, 4, f"PLATA INSTANT; Tudor Sava; cadou {G.ENTITIES[3]}"),
    external(1, 5, "TRANSFER INTERN T1", kind="internal_transfer"),
    external(1, 6, "SALARIU MAI", kind="salary_income"),
]
LATER = [external(2, 1, "BENEFICIAR; Casa Verde; imprumut", "07/02/2027"), external(2, 2, "BENEFICIAR; Casa Verde; rent", "08/02/2027"), external(2, 3, "IBAN; Oana Dima; cadou"), external(2, 4, ";")]
KNOWN = [(G.ENTITIES[3], "Tudor Sava", "Housing", 0.9, "confirmed", "2026-01", "2026-02", 2, "exact_text")]


def test_memory_over_a_restart(spark, tmp_path):
    path, memory = str(tmp_path), spark.createDataFrame(KNOWN, T.MEMORY)
    run(SM.remembered(batches(spark, path, ROW, ENTITY), memory), path)
    first = {r.entity_key for r in SM.memory_of(spark, f"{path}/state").collect()}
    assert first == {"casa verde", G.ENTITIES[3], "salariu mai"}
    run(SM.remembered(batches(spark, path, ROW, LATER), memory), path)
    rows = spark.createDataFrame(ENTITY + LATER, ROW)
    batch = {(r.doc_id, *[r[c] for c in OUT]) for r in T.classify_transfers(rows, memory, fuzzy=False).collect() if r.match_source != "entity_memory_backfill"}
    got = {(r.doc_id, *[r[c] for c in OUT]) for r in spark.read.parquet(f"{path}/out").collect()}
    # The stream does not fill the first row back.
    assert got - batch == {(1, 1, "unknown", "no_signal", "unknown", None, 0.93, None, None)} and batch <= got and len(got) == 10
    learned = T.remember_first(T.own_evidence(T.counterparties(rows), fuzzy=False)).withColumn("month", F.col("last_seen"))
    want = T.upsert_memory(memory, learned.select("entity_key", "canonical_name", "category", "confidence", "status", "evidence_type", "month"))
    assert {tuple(r) for r in SM.memory_of(spark, f"{path}/state").collect()} == {tuple(r) for r in want.collect()}


def test_memory_is_forgotten(spark, tmp_path):
    rows = [external(1, 1, "PLATA INSTANT; Casa Verde; lease", "05/01/2027"), external(1, 2, "PLATA INSTANT; Casa Verde", "05/03/2027"), external(1, 3, "PLATA INSTANT; Casa Verde", "05/09/2027")]
    run(SM.remembered(batches(spark, str(tmp_path), ROW, rows), forget_after=6), str(tmp_path))
    assert {r.seq: r.match_source for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "bootstrap_exact", 2: "entity_memory", 3: "unknown"}
    assert SM.memory_of(spark, f"{tmp_path}/state").count() == 0


def test_micro_batches_in_order(spark, tmp_path):
    """Micro-batches are ranges of documents, one after the other, of a bounded number of rows."""
    from ledgerloom.plans import queries as Q

    rows = spark.createDataFrame([external(d, d, ";") for d in range(100)], ROW).repartition(7)
    parts = []
    q = Q.arriving_in_order(rows, "in-order", "doc_id", 3, 10).writeStream.foreachBatch(lambda df, k: parts.append([r.doc_id for r in df.collect()])).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [sorted(p) for p in parts] == [list(range(k, k + 10)) for k in range(0, 100, 10)]


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_a_large_entity_leaves_in_parts():
    """Rows of an entity arrive as frames in any order, and outcomes leave in frames of bounded size, as they are made."""
    import pandas as pd

    memory = SM.EntityMemory("doc long, row long", None, None)
    memory.known, memory.memory = Held(), Held()
    n, first = 25_000, 7
    own = {"own_state": "confirmed", "own_evidence_type": "exact_text", "own_match_source": "bootstrap_exact", "own_category_area": "Housing", "own_confidence": 0.97, "own_fuzzy_match_term": "rent", "own_fuzzy_match_score": 100.0}
    none = {**{k: None for k in own}, "own_state": "unknown"}
    rows = [{"doc_id": k // 10, "seq": k, "txn_type": "external_transfer", "entity_key": "x", "category_area": None, "confidence": 0.93, "name": "X", "month": "2027-01", "kept": 0.97 if k >= first else None, **(own if k in (first, first + 90) else none)} for k in reversed(range(n))]
    frames = (pd.DataFrame(rows[k : k + 4000]) for k in range(0, n, 4000))
    out = list(memory.handleInputRows(("x",), frames, None))
    assert [len(f) for f in out] == [10_000, 10_000, 5_000]
    whole = pd.concat(out)
    assert list(whole["seq"]) == list(range(n))
    assert list(whole["match_source"]) == [None] * first + ["bootstrap_exact"] + ["entity_memory"] * (n - first - 1)
    assert memory.known.value == ("Housing", 0.97, "exact_text", "2027-01", False, 0, first) and memory.memory.value[0] == "X"


@pytest.mark.parametrize("first,last,months", [("2026-11", "2027-02", 3), ("2027-02", "2027-02", 0), (None, "2027-02", 0), ("unknown", "2027-02", 0)])
def test_months_between(first, last, months):
    assert SM.months_between(first, last) == months


MONEY = "seq long, transaction_id string, ts timestamp, booking_date string, amount double, direction string, source_section string, raw_description string, txn_type string"


def paid(seq, hour, text="POS ZORI", amount=5.0, direction="debit", kind="card_purchase"):
    from datetime import datetime, timedelta

    return (seq, str(seq), datetime(2027, 1, 1) + timedelta(hours=hour), "01/01/2027", amount, direction, "booked_transactions", text, kind)


def test_repeats_and_late_rows(spark, tmp_path):
    path = str(tmp_path)
    for rows in ([paid(1, 0), paid(2, 0, "POS MOLID")], [paid(3, 10), paid(4, 10, " pos  zori "), paid(5, 10, amount=5.001)], [paid(6, 200, "POS NORD")], [paid(7, 201), paid(8, 20, "POS SUD")]):
        run(SD.without_repeats(batches(spark, path, MONEY, rows, 1), "ts", "48 hours"), path)
    # 3, 4 and 5 have the key of 1; 7 comes after the delay and is new; 8 is older than the watermark.
    assert {r.seq for r in spark.read.parquet(f"{path}/out").collect()} == {1, 2, 6, 7}


def test_sides_of_a_transfer(spark, tmp_path):
    path, move = str(tmp_path), lambda seq, hour, ref, direction, amount=9.0: paid(seq, hour, f"TRANSFER INTERN REF: {ref}", amount, direction, "internal_transfer")
    parts = [
        [move(1, 0, "A", "debit"), move(2, 0, "B", "credit"), move(3, 0, "C", "debit"), move(4, 0, "D", "debit", 1.0), paid(5, 0)],
        [move(6, 20, "A", "credit"), move(7, 20, "B", "debit"), move(8, 20, "D", "credit", 2.0), move(9, 20, "A", "debit")],
        [move(10, 100, "C", "credit")],  # too late for its other side
        [paid(11, 500)],
        [move(12, 30, "A", "credit")],  # older than the watermark
    ]
    for rows in parts:
        run(SD.without_mirrors(batches(spark, path, MONEY, rows, 1), "ts", "48 hours"), path)
    got = {(r.seq, r.transaction_id, r.direction) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {(1, "6", "credit"), (2, "2", "credit"), (3, "3", "debit"), (4, "4", "debit"), (8, "8", "credit"), (10, "10", "credit"), (5, "5", "debit"), (11, "11", "debit")}


def test_sides_that_arrive_out_of_order(spark, tmp_path):
    """Of many rows of one reference and amount in a batch the first by seq counts, as in the batch form, not the first that is met."""
    path, move = str(tmp_path), lambda seq, ref, direction: paid(seq, seq, f"TRANSFER INTERN REF: {ref}", 9.0, direction, "internal_transfer")
    rows = [move(s, "E", "credit" if s in (14, 12) else "debit") for s in (15, 14, 13, 12, 11)] + [move(s, "F", d) for s, d in ((25, "debit"), (24, "credit"), (23, "debit"), (22, "credit"))]
    rows += [move(s, "G", "debit") for s in (33, 31, 32)] + [move(s, "H", d) for s, d in ((43, "credit"), (42, "debit"), (41, "none"))]
    for part in (rows, [paid(99, 500)]):
        run(SD.without_mirrors(batches(spark, path, MONEY, part, 1), "ts", "48 hours"), path)
    got = {(r.seq, r.transaction_id, r.direction) for r in spark.read.parquet(f"{path}/out").collect()}
    want = {(r.seq, r.transaction_id, r.direction) for r in D.without_mirrors(spark.createDataFrame(rows + [paid(99, 500)], MONEY))[0].collect()}
    assert got == want == {(11, "12", "credit"), (22, "22", "credit"), (31, "31", "debit"), (41, "41", "none"), (99, "99", "debit")}


def test_streams_of_no_rows(spark):
    from ledgerloom.plans import queries as Q

    none = spark.createDataFrame([], MONEY)
    assert Q.arrived(SD.without_repeats(Q.arriving(none, "none", "seq", 2), "ts"), "none-out")[0].collect() == []
