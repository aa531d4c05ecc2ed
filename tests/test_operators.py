"""Packed values, rejects, orphans, filters, state, vectors and evidence: fixtures, nulls, empty tables, clashing names."""

import datetime as dt

import numpy as np
import pytest

from docweave.operators import enrich, evidence, filters, orphans, packed_values, rejects, state, vectors
from docweave.operators.packed_values import FieldGrammar


def values(text, *names):
    return [v for v, _ in FieldGrammar(names).parse(text)]


def test_shorter_names_are_tried():
    assert values("X; Y; Zebra", "X; Y", "X; Y; Z") == ["X; Y", "Zebra"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        (" ;; ", []),
        ("a; nan; b", ["a", "b"]),
        ('"a; ""b"""; c', ['a; "b"', "c"]),
        ('"open; b', ['"open', "b"]),
        ('["a", "b;c"]', ["a", "b;c"]),
        ("[NaN]", ["[NaN]"]),
        ("a-b - c", ["a-b", "c"]),
        ("a,  b   c|d", ["a", "b c", "d"]),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_malformed_values_are_flagged():
    assert list(FieldGrammar().parse('"open; [1, x')) == [('"open', "bad_quote"), ("[1", "bad_list"), ("x", None)]


def test_packed_table_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a;b", None, "z"), (2, None, "", "z")], "row_id long, nganh string, linh_vuc string, item string")
    cat = spark.createDataFrame([("nganh", None)], "field_name string, name string")
    got = packed_values.split_packed(df, "row_id", ["nganh", "linh_vuc"], cat)
    assert sorted((r.row_id, r.pos, r.item) for r in got.collect()) == [(1, 1, "a"), (1, 2, "b")]
    assert packed_values.split_packed(df.limit(0), "row_id", ["nganh"], cat.limit(0)).count() == 0


def test_reject_reasons(spark):
    meta = "1," + "x," * 10 + "x"
    dated = lambda d: "1,t,s," + d + ",l,,," + "a,b,c,d,e"
    lines = {
        1: ("content.csv", '1,"<p>a\n""b"""', None),
        2: ("content.csv", '1,"open', "quoting"),
        3: ("content.csv", "1,a,b", "column_count"),
        4: ("content.csv", "x1,<p>", "bad_id"),
        5: ("content.csv", "1, ", "bad_html"),
        6: ("content.csv", "1,a�", "bad_html"),
        7: ("metadata.csv", dated("31/02/2020"), "bad_date"),
        8: ("metadata.csv", dated("1-2-2020"), None),
        9: ("content.csv", None, "column_count"),
        10: ("other.csv", "1,2", "unknown_file"),
        11: ("metadata.csv", meta, "bad_date"),
        12: (None, "1,2", "unknown_file"),
    }
    raw = spark.createDataFrame([(i, f, 1, t) for i, (f, t, _) in lines.items()], "raw_id long, file_name string, line_no long, raw_line string")
    loaded, rest = rejects.split_load(raw)
    assert {r.raw_id: r.reason for r in rest.collect()} == {i: r for i, (_, _, r) in lines.items() if r}
    assert {r.raw_id for d in loaded.values() for r in d.collect()} == {1, 8}
    assert rejects.rejected(raw.limit(0)).count() == 0


def test_orphans_with_a_hot_key(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rel = spark.createDataFrame([(i, "1", "99" if i < 900 else " 01", t(5)) for i in range(1000)] + [(2000, None, "nan", t(5))], "row_id long, doc_id string, other_doc_id string, recorded_at timestamp")
    meta = spark.createDataFrame([(1, "1", t(6), None), (2, "7", t(1), None)], "row_id long, doc_id string, loaded_at timestamp, deleted_at timestamp")
    content = spark.createDataFrame([("1", t(7)), (None, t(1))], "id string, loaded_at timestamp")
    found = orphans.orphan_references(rel, meta, content)
    got = {(r.ref_field, r.reason): r.n_refs for r in orphans.orphan_counts(found).collect()}
    assert got == {("relationships.doc_id", "late"): 1000, ("relationships.other_doc_id", "missing"): 900, ("relationships.other_doc_id", "late"): 100, ("metadata.doc_id", "late"): 1, ("metadata.doc_id", "missing"): 1}
    assert orphans.orphan_references(rel.limit(0), meta.limit(0), content.limit(0)).count() == 0


def test_filters():
    assert filters.date_between("c", "bad", None) is None and filters.any_of("c", (" ", "")) is None and filters.predicate(None) is None
    assert filters.sanitized(filters.SearchFilters(nganh=(" ",), issue_date_from=" ")) is None
    assert filters.slug("15/2020/NĐ-CP") == "15_2020_nd_cp" and filters.slug("...") is None
    assert filters.effective_filters(None, "x").nganh == ("x",) and len(filters.indexed_columns()) == 26


def test_status_fold(spark):
    e = spark.createDataFrame([("a", 1, "processing", None, None), ("a", 2, "failed", None, "e"), ("a", 3, "processing", None, None), ("a", 4, "done", 7, None), ("b", 1, "processing", None, None)], "doc_id string, seq int, event string, chunks long, error string")
    got = {r.doc_id: tuple(r)[1:] for r in state.recover_interrupted(state.fold_status(e)).collect()}
    assert got == {"a": ("done", 2, 7, None), "b": ("failed", 1, 0, state.INTERRUPTED)}


def test_fusion_and_limits(spark):
    r = lambda *ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "q int, id string, rank int")
    got = [(x.id, x.score) for x in vectors.fused([r("a", "b"), r("b", "c")], ["q"], "id", 3).orderBy("rank").collect()]
    assert [i for i, _ in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    assert vectors.limits(5, 10) == {"top_k": 5, "candidates": 200, "chunks": 80}


def test_similarity_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).round(3)
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "id int, v array<double>")
    q = v.where("id < 5").selectExpr("id AS q", "v AS qv")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r.q, r["rank"]): r.id for r in vectors.similarity_topk(v, "id", "v", q, "q", "qv", 7).collect()}
    assert got == {(i, k + 1): int(j) for i in range(5) for k, j in enumerate(np.argsort(-(u[i] @ u.T), kind="stable")[:7])}


def test_centroids(spark):
    v = spark.createDataFrame([(1, [float(i % 2), float((i + 1) % 2)]) for i in range(45)], "d int, v array<double>")
    got = vectors.dynamic_centroids(v, ["d"], "v").collect()
    assert len(got) == 3 and sum(r.n_vectors for r in got) == 45
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q int, qv array<double>")
    c = spark.createDataFrame([(1, [-1.0, 0.0])], "q int, centroid array<double>")
    assert vectors.best_similarity(c, q, "q", "qv", ["q"]).first().score == 0.0


def test_evidence_coverage(spark):
    rows = [("a", "local", "x", 1), ("a", "local", "y", 2), ("b", "local", "x", 1), ("b", "web", "u", 2), ("c", "web", "u", 1), ("d", "local", "x", 1), ("d", "local", "x", 2), ("d", "local", "y", 3), ("d", "local", "z", 4)]
    items, summary = evidence.packets(spark.createDataFrame(rows, "g string, source string, item_id string, ord long"), "g", "ord")
    assert {r.g: r.coverage for r in summary.collect()} == {"a": "partial", "b": "partial", "c": "weak", "d": "sufficient"}
    assert sorted(r.citation_id for r in items.where("g = 'd'").collect()) == ["[E1]", "[E2]", "[E3]"]


def test_related_ids_keep_first_order(spark):
    r = spark.createDataFrame([(1, "a", "z", " x "), (2, "a", "b", "y"), (3, "a", "z", None), (4, None, "q", "y")], "row_id int, d string, o string, l string")
    (got,) = enrich.relationship_summary(r, "d", "l", "o", "row_id").collect()
    assert (got.relationship_labels, got.relationship_count, got.related_doc_ids) == (["x", "y"], 3, ["z", "b"])


def test_artifacts(spark, tmp_path):
    from docweave.sources import artifacts

    folder = f"file://{tmp_path}/a"
    points = spark.range(25).selectExpr("cast(id AS string) AS id", "array(1f, 2f) AS dense", "to_json(struct('d' AS doc_id, 't' AS context_text)) AS payload").coalesce(1)
    m = artifacts.write_points(points, folder, shard_size=10)
    assert sorted(s["point_count"] for s in m["shards"]) == [5, 10, 10] and m["vector_size"] == 2
    assert artifacts.import_points(spark, folder, f"{folder}/t") == {"imported": 25, "expected": 25}
    with pytest.raises(Exception, match="(?i)exist"):
        artifacts.write_points(points, folder)
    with pytest.raises(Exception, match="context_text"):
        artifacts.checked_points(spark.sql("SELECT '1' AS id, array(1f) AS dense, '{}' AS payload")).collect()
    assert artifacts.server_version("v1.15.3-dev") == (1, 15, 3)
