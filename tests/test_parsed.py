"""The growing table of parsed statements, and nets of named weights."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import scoring as S
from ledgerloom.operators import statements as P
from ledgerloom.sources import parsed as I
from ledgerloom.sources.tables import read_pages

PAGE = "doc_id string, page_no int, text string"


def page(doc, n, number=1):
    head, foot = [f"antet {k}" for k in range(5)], [f"subsol {k}" for k in range(5)]
    return (doc, number, "\n".join([*head, "TRANZACTII EFECTUATE", f"0{n}/01/2027 POS MOLID {n},50 RON", f"0{n}/01/2027 EPOS ZORI {n},75", *foot]))


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_a_second_run_parses_new_pages_only(spark, tmp_path, monkeypatch):
    store, seen = str(tmp_path / "store"), []
    real = P.parse_statements
    monkeypatch.setattr(P, "parse_statements", lambda pages: seen.append(pages.select("doc_id").distinct().count()) or real(pages))
    old = [page("a", 1), page("b", 2)]
    assert I.parse_new(spark.createDataFrame(old, PAGE), store) == 2
    again = [*old, page("c", 3), ("renamed", *page("b", 2)[1:]), page("d", 4), page("d", 5, 2)]
    every = spark.createDataFrame(again, PAGE)
    assert I.parse_new(every, store) == 2 and I.parse_new(every, store) == 0 and seen == [2, 2]
    assert rows(I.parsed(spark, store, I.page_keys(every))) == rows(real(every))
    changed = spark.createDataFrame([page("a", 6)], PAGE)
    assert I.parse_new(changed, store) == 1
    assert rows(I.parsed(spark, store, I.page_keys(changed))) == rows(real(changed))


def test_a_run_that_breaks_off_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    store, pages = str(tmp_path / "store"), spark.createDataFrame([page("a", 1), page("b", 2)], PAGE)
    monkeypatch.setattr(I, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        I.parse_new(pages, store)
    assert I.parsed(spark, store, I.page_keys(pages)).count() == 0  # entries without their keys do not count
    monkeypatch.undo()
    assert I.parse_new(pages, store) == 2
    assert rows(I.parsed(spark, store, I.page_keys(pages))) == rows(P.parse_statements(pages))
    assert I.parse_new(pages.limit(0), store) == 0


def test_files_are_known_by_content(spark, tmp_path):
    folder, store = tmp_path / "files", str(tmp_path / "store")
    folder.mkdir()
    for name, n in (("one.txt", 1), ("copy.txt", 1), ("two.txt", 2)):
        (folder / name).write_text(page("", n)[2])
    read = lambda: read_pages(spark, str(folder), lambda content: [content.decode()])
    assert I.parse_new(read(), store, I.keys_of_files(spark, str(folder))) == 2
    (folder / "three.txt").write_text(page("", 3)[2])
    keys = I.keys_of_files(spark, str(folder))
    assert I.parse_new(read(), store, keys) == 1
    assert rows(I.parsed(spark, store, keys)) == rows(P.parse_statements(read()))


WEIGHTS = [("shared_trunk.0.weight", [2, 3], [1.0, 0.0, -1.0, 0.5, 0.5, 0.5]), ("shared_trunk.10.weight", [1, 2], [2.0, 1.0]), ("shared_trunk.0.bias", [2], [0.0, 1.0]), ("risk_head.weight", [1, 1], [1.0]), ("savings_head.weight", [1, 1], [-1.0]), ("savings_head.bias", [1], [0.25])]
NAMED = "name string, shape array<int>, values array<double>"


def test_net_of_named_weights(spark):
    import math

    model = S.net_from_weights(spark.createDataFrame(WEIGHTS, NAMED), activation="Tanh")
    assert model.columns == ["x0", "x1", "x2"] and [len(w) for w, _ in model.layers] == [2, 1] and model.risk_head == ([1.0], 0.0)
    out = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(S.dense_scores_udf(model)(F.col("x")).alias("s")).first().s
    h = math.tanh(2 * math.tanh(-2.0) + math.tanh(4.0))
    assert out.risk == pytest.approx(1 / (1 + math.exp(-h))) and out.saving == pytest.approx(1 / (1 + math.exp(h - 0.25)))
    assert S.net_from_weights(spark.createDataFrame(WEIGHTS, NAMED), activation="swish").activation == "relu"


@pytest.mark.parametrize(
    "change, message",
    [
        ({"risk_head.weight": None}, "no weights called risk_head"),
        ({"shared_trunk.10.weight": ([1, 3], [1.0, 1.0, 1.0])}, "takes 3 numbers"),
        ({"shared_trunk.0.weight": ([2, 3], [1.0])}, "has 1 values"),
        ({"shared_trunk.0.bias": ([3], [1.0, 1.0, 1.0])}, "has 3 values, not 2"),
        ({"savings_head.weight": ([2, 1], [1.0, 1.0])}, "not 1 by 1"),
    ],
)
def test_weights_that_do_not_fit(spark, change, message):
    table = [(n, *change.get(n, (s, v))) for n, s, v in WEIGHTS if change.get(n, 0) is not None]
    with pytest.raises(ValueError, match=message):
        S.net_from_weights(spark.createDataFrame(table, NAMED))
