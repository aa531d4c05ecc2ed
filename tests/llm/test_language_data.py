"""Problems 1, 2, 6, 7 and 8: whole results on the smallest tables, brute force on small fixtures, nulls and empty tables."""

import collections
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docweave.llm import endings, mixing, packing, queries, splitting
from docweave.llm.neardup import NearDuplicates
from docweave.llm.splitting import NATURAL, plan, split_text
from tests.conftest import ROOT


def rows(spark, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, ROOT).collect()]


# ---- 1: splitting


def weak_cuts(n, limit, o, marks):
    """The fewest cuts that are not natural, by trying every place."""
    best = {0: 0}
    for at in range(n):
        if at in best:
            low, high = (at + 1, at + limit - o) if at else (o + 1, limit)
            for c in range(low, min(high, n) + 1):
                worth = best[at] + (c < n and marks.get(c, 0) < NATURAL)
                best[c] = min(worth, best.get(c, worth))
    return best[n]


def check_plan(n, limit, o, marks):
    pieces = plan(n, limit, o, marks)
    assert pieces[0].start == 0 and pieces[-1].end == n
    assert all(0 < p.end - p.start <= limit for p in pieces)
    assert all(b.start == a.end - o and b.end > a.end for a, b in zip(pieces, pieces[1:]))
    return sum(p.strength < NATURAL for p in pieces)


def test_a_stretch_without_boundaries_leaves_the_other_cuts_natural():
    marks = {c: 0.1 for c in range(1, 800)} | {c: 0.8 for c in (*range(60, 401, 60), 400, *range(520, 800, 60))}
    assert check_plan(800, 100, 0, marks) == weak_cuts(800, 100, 0, marks) == 1


def test_fewest_unnatural_cuts_on_random_items():
    rng = random.Random(3)
    for _ in range(300):
        n, limit = rng.randrange(30, 300), rng.randrange(8, 60)
        o = rng.randrange(0, limit)
        marks = {c: 0.1 for c in range(1, n)} | {c: rng.choice((0.4, 0.8, 5.0)) for c in rng.sample(range(1, n), rng.randrange(0, n // 6))}
        if n > limit:
            assert check_plan(n, limit, o, marks) == weak_cuts(n, limit, o, marks)


def test_even_sentences_give_balanced_pieces():
    pieces = plan(100, 60, 0, {c: 0.8 for c in range(10, 100, 10)})
    assert [(p.start, p.end) for p in pieces] == [(0, 50), (50, 100)]


def test_headings_in_decomposed_text():
    text = "Đoạn một hai ba.\nĐiều 5. Phạm vi\nĐoạn bốn năm."
    for form in ("NFC", "NFD"):
        s = unicodedata.normalize(form, text)
        assert splitting.boundaries(s)[s.index("\n") + 1] == 5.0


def test_pieces_rebuild_the_text():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(("a ", "bb. ", "\n", "Điều 3. ", "ế", "x", "  ", "| c |\n")) for _ in range(rng.randrange(20, 200)))
        for unit in ("char", "word"):
            got = split_text(text, unit, 17, 3)
            assert got[0][1] == 0 and got[-1][2] == len(text) and all(b[1] <= a[2] for a, b in zip(got, got[1:]))
            size = len if unit == "char" else lambda s: len(re.findall(r"[^ \t\n\r]+", s))
            assert all(size(text[a:b]) <= 17 for _, a, b in got)


def test_p1_found_is_its_sql(same_as_sql):
    same_as_sql(queries.p1_found, queries.SQL["p1_found"])


def test_p1_pieces_cover_what_p1_found_lists(spark):
    assert {p[:2] for p in rows(spark, "p1_pieces")} == set(rows(spark, "p1_found"))


def test_p1_found_comes_through_the_plans(spark):
    from tests.conftest import ROOT

    plan = queries.p1_found(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "cut(" in plan and "size(" in plan


def test_p1_nulls_limits_and_repeats(spark):
    items = spark.createDataFrame([("chunk", "a", "x", "v", "q w e r"), ("chunk", "a", "x", "v", "q w e r"), ("chunk", "b", None, "v", None), ("chunk", "c", "x", None, "q w e r"), ("node", "d", "table", "v", "q w e"), ("node", "e", "x", "v", "q w e")], "item_kind string, item_id string, item_type string, pipeline_version string, text string")
    conf = spark.createDataFrame([("v", "word", 3, 1, 2)], "pipeline_version string, size_unit string, chunk_size int, chunk_overlap int, table_chunk_size int")
    got = splitting.split_oversized(items, conf).collect()
    assert sorted((r.item_id, r.piece_no, r.text) for r in got) == [("a", 1, "q w e "), ("a", 2, "e r"), ("d", 1, "q w "), ("d", 2, "w e")]
    assert splitting.split_oversized(items.limit(0), conf).count() == 0


# ---- 2: near-duplicates


def plain_pairs(data, tenths=7):
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t or "").lower())
        if len(w) >= 40:
            sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= tenths * len(sets[a] | sets[b])}


def near(spark, data):
    return NearDuplicates(spark.createDataFrame(data, "id string, text string"))


def test_pairs_at_exactly_seven_tenths(spark):
    data = []
    for k in range(2000):
        words = [f"w{k}x{i}" for i in range(44)]
        data += [(f"{k}{s}", " ".join(words + [f"{s}{k}x{i}" for i in range(9)])) for s in "ab"]
    assert {tuple(r) for r in near(spark, data).pairs().collect()} == {(f"{k}a", f"{k}b") for k in range(2000)}


def test_random_edits_forms_copies_and_nulls(spark):
    rng = random.Random(5)
    data = [("n", None), ("e", ""), (None, "x " * 50)]
    for k in range(25):
        words = [f"từ{rng.randrange(60)}" for _ in range(rng.randrange(45, 150))]
        for c in range(8):
            edit = [w if rng.random() > 0.012 * c else f"e{rng.randrange(60)}" for w in words]
            text = " ".join(edit[: len(edit) - rng.randrange(6)])
            data.append((f"{k:02}-{c}", unicodedata.normalize("NFD", text) if c % 3 == 0 else text.upper()))
    data += [(f"copy{i}", data[3][1]) for i in range(450)] + data[3:6]
    n = near(spark, data)
    want = plain_pairs([x for x in dict(data).items() if x[0]])
    assert {tuple(r) for r in n.pairs().collect()} == want
    groups = {r.id: r.group for r in n.groups().collect()}
    assert set(groups) == {x for p in want for x in p} and all(groups[a] == groups[b] for a, b in want)


def test_no_records(spark):
    n = near(spark, [("a", None)])
    assert n.pairs().count() == 0 and n.groups().count() == 0


# ---- 6: packing


def test_p6_places_every_token_once(spark):
    from docweave.session import table

    sizes = {r.doc_id: r.n_tokens for r in packing.token_sizes(table(spark, ROOT, "documents")).collect()}
    caps = {r.pack_name: r.capacity_tokens for r in table(spark, ROOT, "pack_sizes").collect()}
    room, placed = collections.Counter(), collections.defaultdict(list)
    for pack, no, doc, _, start, n in rows(spark, "p6_contexts"):
        room[pack, no] += n
        placed[pack, doc].append((start, n))
    assert all(n <= caps[pack] for (pack, _), n in room.items())
    for pack, cap in caps.items():
        for doc, n in sizes.items():
            parts = sorted(placed[pack, doc])
            assert [s for s, _ in parts] == list(range(0, n, cap)) and sum(k for _, k in parts) == n


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_each_size_and_fit(seed):
    rng = random.Random(seed)
    h = dict(collections.Counter(min(500, int(rng.lognormvariate(4.5, 0.8)) + 1) for _ in range(5000)))
    plan_, fitted = packing.plan_contexts(h, 512)
    got = collections.Counter()
    for times, pattern in plan_:
        assert times > 0 and sum(s * n for s, n in pattern) <= 512
        for s, n in pattern:
            got[s] += times * n
    least = math.ceil(sum(s * n for s, n in h.items()) / 512)
    assert got == h and fitted > 0 and sum(t for t, _ in plan_) <= 1.02 * least + 2
    assert packing.plan_contexts({}, 512) == ([], 0)


def test_nnls_solves_a_known_case():
    x = packing.nnls([[(3, 2)], [(3, 1), (5, 1)]], {3: 50, 5: 10}, 2000)
    assert x[0] == pytest.approx(20, abs=0.1) and x[1] == pytest.approx(10, abs=0.1)


# ---- 7: mixing


def test_water_filling():
    assert mixing.water_fill(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}) == pytest.approx({"a": 10, "b": 54, "c": 36})
    assert mixing.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert mixing.water_fill(100, {"a": 0.5, "b": 0.5}, {"b": 200}) == {"a": 0, "b": 100}
    assert mixing.exact_budget({"a": 0.5, "b": 0.5}, {"a": 10, "b": 200}) == 20


@pytest.mark.parametrize("budget", ["once", "exact", 4000])
def test_p7_uses_keep_the_caps_and_the_shares(spark, budget):
    sizes = spark.createDataFrame([(i, "a" if i < 400 else "b" if i < 500 else None, 10 + i % 7) for i in range(520)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 3), ("n", "a", 0.5, 1), ("n", "c", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    most = {("m", "a"): 1, ("m", "b"): 3, ("n", "a"): 1}
    used = mixing.uses(sizes, targets, budget).collect()
    assert used and all(1 <= r.uses <= most[r.mix_name, r.source] for r in used)
    assert len({(r.mix_name, r.doc_id) for r in used}) == len(used)
    want = {(r.mix_name, r.source): r.wanted for r in mixing.allotments(sizes, targets, budget).collect()}
    got = collections.Counter()
    for r in used:
        got[r.mix_name, r.source] += r.uses * r.n_tokens
    assert all(abs(got[k] - w) <= 9 for k, w in want.items())
    for r in mixing.shares(sizes, targets, budget).collect():
        assert r.reached_share == pytest.approx(r.wanted_share, abs=0.01)
    assert mixing.uses(sizes.limit(0), targets, budget).count() == 0


# ---- 8: lost ends


def test_lost_ends_on_held_out_texts(spark):
    """Whole texts of a small grammar and seeded cuts of them, none of which the fit sees as such."""
    rng = random.Random(7)
    subject, verb, thing = ["Chủ đầu tư", "Ban quản lý", "Hội đồng", "Nhà thầu"], ["phải nộp", "được cấp", "kiểm tra", "thông báo"], ["hồ sơ dự thầu", "giấy phép", "bảng lương", "kế hoạch bảo trì"]
    close = [".", ".", "./.", ".\n(Đã ký)", ".\nCHỦ TỊCH", ".\nNgười đề nghị: ..........", "| a | b |"]

    def whole():
        body = " ".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} trong {rng.randrange(90)} ngày." for _ in range(rng.randrange(2, 9)))
        end = rng.choice(close)
        return body + "\n| 1 | 2 |\n| 3 | 4 |" if end[0] == "|" else body[:-1] + end

    data, lost = [], set()
    for i in range(2500):
        t = whole()
        if i % 8 == 0:
            at = rng.randrange(20, len(t) - 12)
            if t[at - 1] not in ".|)_" and t[at - 2] != ".":
                t, lost = t[:at], lost | {i}
        data.append((i, t, "s" if i % 3 else None))
    data += [(9000, None, "s"), (9001, " \n", "s"), (1, data[1][1], "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    judged = {r.doc_id: r.lost for r in endings.judged(df).collect()}
    found = {i for i, x in judged.items() if x}
    assert 9000 not in judged and 9001 not in judged and len(judged) == 2500
    assert len(found & lost) >= 0.95 * len(lost) and len(found & lost) >= 0.95 * len(found)


def test_length_limits(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "IF(id % 4 = 0, repeat('x', 300), repeat('y', cast(20 + id AS int))) AS text", "'s' AS source")
    limits, total = endings.length_limits(df)
    assert total == 400 and 300 in limits.first().char_limits


def test_p8_rates_count_every_text(spark):
    from docweave.session import table

    n = table(spark, ROOT, "documents").where(F.col("text").rlike(r"(?U)\S")).count()
    got = rows(spark, "p8_rates")
    assert sum(r[1] for r in got) == n
    assert endings.judged(table(spark, ROOT, "documents").limit(0)).count() == 0


# ---- registration


def test_every_problem_has_a_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"p{k}_") for n in names) for k in range(1, 9))


def test_a_missing_dependency_is_an_error():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert done.returncode and "xxhash" in done.stderr
