"""Text operators against brute force on small hand-made and given rows, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents and awkward ones; n_words and kept clash with names that operators use."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    for k in range(30):  # a group of near copies
        edited = list(base)
        for _ in range(k % 5 + 1):
            edited[rnd.randrange(300)] = f"e{rnd.random()}"
        rows.append((5000 + k, " ".join(edited)))
    rows += [(6000, None), (6001, ""), (6002, " \n\t "), (6003, "one two"), (6004, "ONE Two"), (6005, "the same"), (6005, "the same"), (None, "a null id here"), (6006, "x " * 30_000)]
    rows += [(7000 + k, " ".join(base)) for k in range(20)]  # exact copies
    rows.append((8000, "Don't 'RE x'll naïve 12ab <|endoftext|>b İ 日本 \x1c ### café ́x"))
    return spark.createDataFrame([(i, t, "kept", 7) for i, t in rows], "doc_id long, text string, kept string, n_words int").repartition(3).cache()


def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(ASCII))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    at = defaultdict(list)
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(k)] = root(j)
        for x in s:
            at[x].append(k)
    return sets, [root(k) for k in range(len(texts))]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, width, percent):
    from blockscope.llm.near_dedup import near_duplicates

    rows = [r for r in rows_of(docs) if r[0] is not None]
    sets, root = brute_components([t for _, t in rows], width, percent)
    least = defaultdict(lambda: math.inf)
    for (i, _), r in zip(rows, root):
        least[r] = min(least[r], i)
    want = sorted((i, len(s), least[r], least[r] == i) for (i, _), s, r in zip(rows, sets, root))
    got = near_duplicates(docs, width, percent).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    assert near_duplicates(docs, width, percent).where("doc_id is null").count() == 1
    assert near_duplicates(empty(docs), width, percent).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_missing_ids_lose_no_link(spark, kind):
    from blockscope.llm.near_dedup import near_duplicates

    rnd = random.Random(6)
    base = [[f"t{k}w{rnd.randrange(500)}" for _ in range(200)] for k in range(4)]
    text = lambda k, *more: " ".join([*base[k], *more])
    rows = [(5, text(0)), (5, text(1)), (7, text(1, "x")), (8, text(1, "y")), (9, text(0, "z")), (9, text(0, "z"))]
    rows += [(20, " ".join(base[2])), (None, " ".join(base[2][14:] + ["p"] * 14)), (21, " ".join(base[2][28:] + ["p"] * 14 + ["q"] * 14)), (None, text(3)), (None, text(3, "x"))]
    known = [(i, t) for i, t in rows]
    _, root = brute_components([t for _, t in known], 3, 85)
    ids = lambda r: [i for (i, _), q in zip(known, root) if q == r and i is not None]
    want = sorted(((i, min(ids(r)) if ids(r) else None) for (i, _), r in zip(known, root)), key=str)
    assert (21, 20) in want  # only a row without an id links them
    name = (lambda i: i) if kind == "long" else (lambda i: i if i is None else f"id-{i:03d}")
    got = near_duplicates(spark.createDataFrame([(name(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(3), 3, 85).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(((name(i), name(c)) for i, c in want), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_oversized_groups_are_cut_into_blocks(spark, docs, monkeypatch):
    from blockscope.llm import near_dedup

    want = sorted(map(tuple, near_dedup.near_duplicates(docs, 3, 85).select("doc_id", "component_id").where("doc_id is not null").collect()))
    for name, size in (("BLOCK", 4), ("BLOCK_SHINGLES", 150)):
        with monkeypatch.context() as m:
            m.setattr(near_dedup, name, size)
            assert sorted(map(tuple, near_dedup.near_duplicates(docs, 3, 85).select("doc_id", "component_id").where("doc_id is not null").collect())) == want, name


def test_blocks_of_a_hot_cluster_are_bounded_by_shingles(spark, monkeypatch):
    from blockscope.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1000)
    members = spark.range(60).select(F.lit(1).alias("cluster"), F.col("id").alias("node"), F.lit(100).alias("n")).unionByName(spark.createDataFrame([(2, 1, 10**7), (3, 1, 10**7), (3, 2, 5)], "cluster int, node long, n int"))
    groups = near_dedup._in_blocks(members, "cluster", "node", F.col("n")).cache()
    met = {}
    for r in groups.collect():
        met.setdefault((r["cluster"], r["left"], r["right"]), []).append(r["node"])
    assert all(len(nodes) < 45 for (c, *_), nodes in met.items() if c == 1) and (2, 0, 0) in met
    pairs = {(a, b) for (c, *_), nodes in met.items() if c == 1 for a in nodes for b in nodes if a < b}
    assert len(pairs) == 60 * 59 // 2  # every pair meets
    assert any(c == 3 and set(nodes) == {1, 2} for (c, *_), nodes in met.items())


def test_drop_near_duplicates_keeps_columns_and_one_of_each_group(spark, docs):
    from blockscope.llm.near_dedup import drop_near_duplicates

    left = drop_near_duplicates(docs, 5, 80)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert len([i for i in ids if i is not None and (5000 <= i < 5030 or 7000 <= i < 7020)]) == 1
    assert {6000, 6001, 6002} <= ids


def test_drop_near_duplicates_goes_by_rows(spark):
    from blockscope.llm.near_dedup import drop_near_duplicates

    rnd = random.Random(5)
    texts = [" ".join(f"t{k}w{rnd.randrange(500)}" for _ in range(200)) for k in range(7)]
    near = [t + " end" for t in texts]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1]), (9, near[0])]  # id 5 stands for two texts, one of them also under id 3
    rows += [(None, texts[2]), (None, texts[2]), (None, near[2])] + [(None, texts[3]), (4, near[3])]
    rows += [(6, texts[4])] * 3 + [(7, texts[5]), (7, texts[6]), (2, near[6])]
    rows += [(8, None), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    left = drop_near_duplicates(docs, 5, 80)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert sum(got.pop((None, t), 0) for t in (texts[2], near[2])) == 1
    assert got == Counter([(5, texts[0]), (3, texts[1]), (4, near[3]), (6, texts[4]), (7, texts[5]), (2, near[6]), (8, None), (8, None), (None, "")])


def test_sketch_bound_and_banding():
    from blockscope.llm.near_dedup import banding, sketch_bound

    for t in (0.8, 0.85):
        bands, rows = banding(t)
        assert (1 - t**rows) ** bands <= 1e-6
        assert sketch_bound(t, bands * rows) < 128


LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def brute_lines(rows, min_words):
    """Every repeated run of every length, by comparing all starts."""
    lines = {}
    for key, t in rows:
        lines[key] = [(at, line.strip(" \t\n\x0b\x0c\r")) for at, line in enumerate((t or "").split("\n")) if WORD.search(line)]
    first, gone = {}, defaultdict(set)
    for key in sorted(lines, key=lambda k: (k[0], k[1])):
        ls = lines[key]
        for s in range(len(ls)):
            words = 0
            for e in range(s, len(ls)):
                words += len(WORD.findall(ls[e][1]))
                run = tuple(x for _, x in ls[s : e + 1])
                if run in first:
                    if words >= min_words:
                        gone[key] |= {at for at, _ in ls[s : e + 1]}
                else:
                    first[run] = key
    return gone, lines


def test_line_dedup_against_all_runs(spark):
    from blockscope.llm.line_dedup import drop_repeated_lines, line_report

    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(3)) for _ in range(rnd.randrange(1, 12))) for _ in range(12)]
    rows = [(k, "\n".join(rnd.choice([*pool, "", "  ", f"u{rnd.random()}"]) for _ in range(rnd.randrange(0, 25)))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(0, 60, 7)] + [(200, None), (201, ""), (202, " \n "), (203, LINE + "\n" + LINE + "\n" + LINE), (204, "  " + LINE + " \n" + LINE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).repartition(3)
    gone, lines = brute_lines([((i, 0), t) for i, t in rows], 20)
    want = {}
    for i, t in rows:
        cut = gone[(i, 0)]
        text = "\n".join(x for at, x in enumerate(t.split("\n")) if at not in cut) if cut else t
        want[i] = (len(lines[(i, 0)]), len(cut), not cut or len(cut) < len(lines[(i, 0)]), hashlib.md5(text.encode()).hexdigest() if text is not None else None)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"], r["text_md5"]) for r in line_report(docs, 20).collect()}
    assert got == want
    left = drop_repeated_lines(docs, 20)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, w in want.items() if w[2]}
    assert drop_repeated_lines(docs.where("false"), 20).count() == 0


def test_line_dedup_with_awkward_rows(spark, docs):
    from blockscope.llm.line_dedup import line_report

    got = {r["doc_id"]: r for r in line_report(docs).collect()}
    assert got[7000]["kept"] and not got[7001]["kept"] and got[6000]["n_lines"] == 0 and got[6002]["kept"] and got[None]["kept"]


def test_line_dedup_against_sql(spark):
    import duckdb

    from blockscope.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE["op2_line_dedup"]).df()
    got = QUERIES["op2_line_dedup"](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_ngram_scores_against_formulas(spark, docs):
    from blockscope.llm.ngram import held_out_scores

    rows = [(i, t) for i, t in rows_of(docs) if i is not None]
    tokens = [[*WORD.findall((t or "").translate(ASCII)), None] for _, t in rows]
    pairs, count = Counter(), Counter()
    for (i, _), w in zip(rows, tokens):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
            pairs.update(zip(["<"] + w, w))
    before = Counter(w for _, w in pairs)
    context, kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in pairs.items():
        context[u] += c
        kinds[u][min(c, 3)] += 1

    def steps(values):
        n = Counter(values)
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    high, low = steps(pairs.values()), steps(before.values())
    total, v, n_all = len(pairs), len(count), sum(count.values())
    left = sum(low[min(c, 3)] for c in before.values()) / total

    def p(u, w):
        base = max(before[w] - low[min(before[w], 3)], 0) / total + left / (v + 1)
        if not context[u]:
            return base
        c = pairs[u, w]
        return max(c - high[min(c, 3)], 0) / context[u] + sum(high[k] * kinds[u][k] for k in (1, 2, 3)) / context[u] * base

    vocabulary = [*count, "never seen"]
    assert sum(p("the", w) for w in vocabulary) == pytest.approx(1)
    got = defaultdict(list)
    for r in held_out_scores(docs.where("doc_id is not null")).collect():
        got[r["doc_id"]].append(r)
    for (i, _), w in zip(rows, tokens):
        r = got[i].pop()
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["n_tokens"] == len(w) and r["train_tokens"] == n_all
        assert r["n_known"] == sum(count[x] > 0 for x in w)
        assert r["score"] == pytest.approx(sum(math.log10(p(u, x)) for u, x in zip(["<"] + w, w)))
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n_all + v + 1)) for x in w))
    assert held_out_scores(docs).where("doc_id is null").count() == 1
    assert held_out_scores(empty(docs)).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_ngram_scores_of_higher_orders(spark, docs, order):
    from blockscope.llm.ngram import held_out_scores

    rows = [(i, t) for i, t in rows_of(docs) if i is not None]
    tokens = {(i, t): ["<", *WORD.findall((t or "").translate(ASCII)), None] for i, t in rows}
    seen = [Counter() for _ in range(order + 1)]
    for key in rows:
        if zlib.crc32(str(key[0]).encode()) % 7 != 2:
            w = tokens[key]
            seen[order].update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
            for n in range(2, min(order, len(w) + 1)):
                seen[n][tuple(w[:n])] += 1
            seen[0].update(w[1:])
    for n in range(order - 1, 0, -1):
        seen[n].update(g[1:] for g in seen[n + 1])
    steps, total, kinds = [None], defaultdict(int), defaultdict(lambda: [0, 0, 0, 0])
    for n in range(1, order + 1):
        k = Counter(seen[n].values())
        y = k[1] / (k[1] + 2 * k[2]) if all(k[j] for j in (1, 2, 3, 4)) else None
        steps.append([0, 0.5, 1.0, 1.5] if y is None else [0, *(min(max(j - (j + 1) * y * k[j + 1] / k[j], 0), j) for j in (1, 2, 3))])
        for g, c in seen[n].items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]][min(c, 3)] += 1

    def p(g):
        n, of = len(g), (len(g), g[:-1])
        rest = p(g[1:]) if n > 1 else 1 / (len(seen[0]) + 1)
        if not total[of]:
            return rest
        return (max(seen[n][g] - steps[n][min(seen[n][g], 3)], 0) + sum(steps[n][k] * kinds[of][k] for k in (1, 2, 3)) * rest) / total[of]

    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in held_out_scores(docs.where("doc_id is not null"), order=order).collect()}
    for key in rows:
        w = tokens[key]
        assert got[key[0], len(w) - 1] == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(1, len(w))))
    assert held_out_scores(empty(docs), order=order).count() == 0


def test_the_registered_scores_are_of_the_third_order(spark):
    from blockscope.llm.ngram import held_out_scores
    from blockscope.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    registered, second, third = (t.agg(F.sum("score")).first()[0] for t in (QUERIES["op3_ngram_scores"](spark, SF), held_out_scores(docs), held_out_scores(docs, order=3)))
    assert registered == pytest.approx(third) and registered != pytest.approx(second)


def test_text_statistics(spark, docs):
    from blockscope.llm.quality_rules import PREFIX, text_statistics

    for r in text_statistics(docs).select("text", PREFIX + "stats").collect():
        text = r["text"] or ""
        w = WORD.findall(text)
        triples = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        s = r[PREFIX + "stats"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_find_bad_texts_and_keep_good_ones(spark):
    from blockscope.llm.quality_rules import learn_rules, quality_verdicts

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    assert learn_rules(docs, fit)
    got = quality_verdicts(docs, fit).join(rest, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] > 0.995 and kept[0] < 0.05


def test_quality_verdicts_against_rules_read_row_by_row(spark):
    from blockscope.llm.quality_rules import MIN_COVER, PREFIX, _gain, cover, features, learn_rules, quality_verdicts, text_statistics

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = learn_rules(docs, labels)
    values = features(F.col(PREFIX + "stats"))
    rows = {r["doc_id"]: r for r in text_statistics(docs, "text").select("doc_id", *(v.alias(k) for k, v in values.items())).collect()}
    got = quality_verdicts(docs, labels).collect()
    assert rules and len(got) == len(rows)
    for r in got:
        first = 0
        for number, rule in enumerate(rules, 1):
            if all((rows[r["doc_id"]][name] <= limit) == (sign == "<=") for name, sign, limit in rule):
                first = number
                break
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["rule"], r["base_failed"], r["kept"]) == (first, failed, not failed and not first)
    # the first condition of the first rule, by trying all
    rnd = random.Random(2)
    table = [(bad := rnd.random() < 0.4, True, (rnd.gauss(2.0 if bad else 0.0, 1.0), rnd.random())) for _ in range(300)] + [(k % 2 == 0, False, (2.5 if k % 2 == 0 else -1.0, 0.5)) for k in range(100)]
    name, sign, limit = cover(table, ["a", "b"])[0][0]
    grow = [(b, v) for b, g, v in table if g]
    p0 = sum(b for b, _ in grow)

    def gain(k, sign, limit):
        inside = [b for b, v in grow if (v[k] <= limit) == (sign == "<=")]
        p = sum(inside)
        return _gain(p, len(inside) - p, p0, len(grow) - p0) if p >= MIN_COVER else -1.0

    best = max(gain(k, s, v[k]) for k in (0, 1) for s in ("<=", ">") for _, v in grow)
    assert name == "a" and gain(0, sign, limit) > 0.9 * best


def test_quality_rules_without_labels(spark, docs):
    from blockscope.llm.quality_rules import filter_quality, quality_verdicts

    labels = spark.createDataFrame([(6000, None), (None, 1), (5000, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_verdicts(docs, labels).collect()}
    assert got[5000]["kept"] and got[6000]["base_failed"] and got[6006]["base_failed"] and not got[6003]["kept"]
    assert filter_quality(docs, labels).columns == docs.columns
    assert quality_verdicts(empty(docs), labels.where("false")).count() == 0


def test_sharding(spark, docs):
    from blockscope.llm.sharding import shard_by_bytes

    got = shard_by_bytes(docs, 8).collect()
    texts = Counter((i, t or "") for i, t in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({(i, len(t.encode()) + 1, zlib.crc32(t.encode())): n for (i, t), n in texts.items()})
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(r["group_digest"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(int)
    for r in got:
        groups[r["group_digest"]] += r["size"]
    sizes = [groups[k] for k in sorted(groups)]

    def shards(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards(mid) <= 8 else (mid + 1, high)
    assert max(sum(r["size"] for r in got if r["shard"] == k) for k in slots) == low
    assert shard_by_bytes(empty(docs), 8).count() == 0
    one = shard_by_bytes(docs.where("doc_id = 6000"), 8).first()
    assert (one["size"], one["text_crc32"], one["shard"], one["slot"]) == (1, 0, 0, 0)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, and a long sentence about them.</div><aside>Side text</aside><article><h1>Head&amp;line</h1><p>First  paragraph of the
article, with <b>bold</b> text that is long enough to count as content.<p>Short.</p><ul><li>One<li>Two</ul></article>
<section id="comments"><p>I liked this article a great deal and will now say so at length.</p></section><form>Name <input></form><footer>&copy; us</footer>"""


def test_html(spark):
    from blockscope.llm.html_extract import extract_main_text

    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p>Only &eacute;"), (4, "u", "<div><nav>x</nav>"), (1, "u", PAGE), (5, "u", "plain words")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()))
    main = "Head&line First paragraph of the article, with bold text that is long enough to count as content. Short. One Two"
    assert got == sorted([(1, main, len(main)), (1, main, len(main)), (2, "", 0), (0, "", 0), (3, "Only é", 6), (4, "", 0), (5, "plain words", 11)])
    assert extract_main_text(pages.where("false")).count() == 0


def _paragraphs(n, size, tag="p"):
    return [f"<{tag}>{(f'{tag}{k} of {size} ' + 'word ' * size)[:size].strip()}</{tag}>" for k in range(n)]


HEAD, LONG, SHORT = "<h2>Summary</h2>", "".join(_paragraphs(3, 600)), "".join(_paragraphs(4, 30))


@pytest.mark.parametrize(
    "page,wanted",
    [
        (f"<body><nav>Home</nav><article><section>{LONG}</section><section>{HEAD}{SHORT}</section></article><footer>us</footer></body>", [LONG, HEAD, SHORT]),
        (f"<body><nav>Home</nav><main><div>{SHORT}</div><aside>side</aside><div>{LONG}</div><div>{HEAD}</div></main></body>", [SHORT, LONG, HEAD]),
        (f"<body><nav>Home</nav><div><div><div>{LONG}</div><div class='share'>Share</div><div>{HEAD}{SHORT}</div></div></div><div>unmarked</div></body>", [LONG, HEAD, SHORT]),
        (f"<body><nav>Home</nav>{HEAD}{LONG}{SHORT}<footer>us</footer></body>", [HEAD, LONG, SHORT]),
        (f"<body><article><p>Opening.</p>{SHORT}<blockquote><blockquote>{LONG}</blockquote><p>Said so.</p></blockquote>{SHORT}</article></body>", ["<p>Opening.</p>", SHORT, LONG, "<p>Said so.</p>", SHORT]),
        (f"<div><a href=a>Home</a> <a href=b>About</a> <a href=c>More</a></div>{LONG}{SHORT}<p><a href=d>One link</a></p>", [LONG, SHORT, "<p>One link</p>"]),
    ],
)
def test_html_keeps_the_short_parts_of_an_article(page, wanted):
    from blockscope.llm.html_extract import main_text

    assert main_text(page) == " ".join(re.sub("<[^>]*>", " ", "".join(wanted)).split())


LONG = "<p>" + "word " * 60 + "</p>"


@pytest.mark.parametrize("page, wanted", [
    ("<html><head><title>T</title><body>" + LONG * 3, 3),
    ("<html><head><title>T</title>" + LONG * 3, 3),
    ('<body><div class="layout sidebar-right"><article>' + LONG * 3 + "</article></div>", 3),
    ('<body><div class="post share-enabled">' + LONG * 3 + "</div><nav>Home</nav>", 3),
    ('<body><div id="search-results-page"><div>' + LONG * 3 + "</div></div>", 3),
    ('<body><div class="content-comments"><main>' + LONG + "</main></div>", 1),
    ("<body><article>" + LONG + '</article><ol class="commentlist">' + ("<li><article>" + LONG + "</article>") * 5 + "</ol>", 1),
    ('<body><div class="ad">' + LONG + "</div><article><h1>word</h1></article>", 1 / 60),
    ('<body><div class="menu">' + '<a href="#">word word</a>' * 9 + "</div>" + LONG, 1),
])
def test_html_takes_names_as_weak_evidence(page, wanted):
    from blockscope.llm.html_extract import main_text

    assert main_text(page).split() == ["word"] * round(60 * wanted)


PROSE = "<p>" + "prose that reads on " * 20 + "</p>"


@pytest.mark.parametrize("page, wanted", [
    ('<body><form id="aspnetForm"><div class="nav">Home</div><div>' + PROSE * 2 + "</div><input></form>", PROSE * 2),
    ('<body><form id="aspnetForm"><article>' + PROSE * 2 + "</article></form>", PROSE * 2),
    ("<body><article>" + PROSE + '<section id="discussion"><h2>Discussion</h2>' + PROSE + '</section><section id="related-work">' + PROSE + '</section><section id="binary-search"><p>Short.</p></section></article>',
     PROSE + "Discussion" + PROSE * 2 + "Short."),
    ("<body><article>" + PROSE + '<div class="social-history"><p>Few words</p></div><p class="notice-period">Four weeks.</p><div class="share">Share this</div></article>', PROSE + "Few words Four weeks."),
    ("<body><article>" + PROSE + '<section id="comments">' + PROSE + '</section><div class="ad-box">' + PROSE + "</div></article>", PROSE),
    ("<body><div>Home | News | Sport</div><div>Buy cheap shoes now! Call 555.</div>" + PROSE * 3 + "<p>Short end.</p><div>All rights reserved 2020</div>", PROSE * 3 + "Short end."),
    ("<body><div>" + PROSE * 3 + '</div><div id="responses">' + PROSE + '</div><div id="thread">' + PROSE + '</div><div class="user-reviews">' + PROSE + "</div>", PROSE * 3),
    ("<body><div>Title line</div>" + ("<div>" + "words of it " * 30 + "</div><div>He said so.</div>") * 2 + "<div>" + "words of it " * 30 + "</div>", ("words of it " * 30 + "He said so. ") * 2 + "words of it " * 30),
])
def test_html_lets_ratios_overrule_names(page, wanted):
    from blockscope.llm.html_extract import main_text

    assert main_text(page) == " ".join(re.sub("<[^>]*>", " ", wanted).split())


def test_html_without_ratios_gives_other_results(monkeypatch):
    import numpy as np

    from blockscope.llm import html_extract

    page = "<body><div>Home | News | Sport</div>" + PROSE * 3 + "<div>All rights reserved 2020</div>"
    with_ratios = html_extract.main_text(page)
    monkeypatch.setattr(html_extract, "smoothed", lambda ratios, sigma: np.ones(len(ratios)))
    assert html_extract.main_text(page) != with_ratios


def test_html_of_the_given_pages(spark):
    """A plain second way, which knows that each given page has one article: its text between block tags."""
    import html

    from blockscope.llm.html_extract import BLOCK, extract_main_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    blocks = re.compile(r"<!--.*?-->|</?(?:%s)(?:\s[^>]*)?/?>" % "|".join(BLOCK), re.S | re.I)
    for r in pages.collect():
        found = re.search(r"<article[^>]*>(.*?)</article>", r["html"] or "", re.S)
        plain = html.unescape(re.sub(r"<[^>]*>", "", blocks.sub(" ", found[1]))) if found else ""
        assert got[r["page_id"]] == " ".join(plain.split()), r["page_id"]


@pytest.mark.parametrize("part", ["<font>", "<font>x", "<div>x", "<p>x", "<a>x", "</b>", '<div class="menu">x', "<li><ul>x"])
def test_html_takes_linear_time(part):
    import time

    from blockscope.llm.html_extract import main_text

    began = time.process_time()
    main_text(part * 100_000)
    assert time.process_time() - began < 20  # seconds; hours where the time is quadratic


def test_warc_round_trip(spark, tmp_path):
    from blockscope.llm.warc import read_records, read_warc, write_warc

    big = "<html>" + "long page " * 300
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "é" * 600), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    manifest = write_warc(pages, f"file://{tmp_path}/w")
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = {r["page_id"]: r for r in read_warc(manifest, with_payload=True).collect()}
    for i, _, html in rows:
        payload, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if i in (1, None) else ("response", None))
        assert r["payload"] == (None if i in (1, None) else payload)
    path = manifest.first()["path"]
    assert all(h["WARC-Record-ID"].startswith("<urn:uuid:") for h, _, _ in read_records(path))
    # each record is a frame of its own behind the dictionary frame
    import struct

    import zstandard

    raw = open(path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    unpack, rest, frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])), raw[8 + size :], 0
    while rest:
        one = unpack.decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = one.unused_data, frames + 1
    assert frames == manifest.first()["n_records"]
    assert read_warc(write_warc(pages.where("false"), f"file://{tmp_path}/e")).count() == 0


LOWER_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_windows(items, window):
    out = defaultdict(lambda: defaultdict(set))
    for i, t in items:
        b = LOWER_WORD.findall((t or "").translate(ASCII))
        n = min(window, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            out[n][tuple(b[k : k + n])].add(str(i))
    return out


def brute_contamination(text, windows):
    w = LOWER_WORD.findall((text or "").translate(ASCII))
    hit, found = set(), set()
    for n, owners in windows.items():
        for k in range(len(w) - n + 1):
            if own := owners.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                found |= own
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_words", [100_000, 60])
def test_contamination(spark, docs, monkeypatch, max_words):
    from blockscope.llm import decontaminate as d

    monkeypatch.setattr(d, "MAX_WORDS", max_words)
    rows = [(i, t) for i, t in dict((r for r in rows_of(docs) if r[0] is not None and r[0] != 6006)).items()]
    rnd = random.Random(2)
    letters = [(9000 + k, " ".join(rnd.choice("ab") for _ in range(40))) for k in range(20)]
    rows += letters
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "one two"), (901, "a b a"), (902, " ".join("abbabaababbaabab")), (903, None), (904, "..."), (905, "naïve"), (906, letters[0][1])]
    rows.append((9100, "x. " + (items[0][1] or "") + " tail, " + "One: TWO"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string")
    windows = brute_windows(items, 10)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in d.contamination(table, bench).collect()}
    assert got == {i: brute_contamination(t, windows) for i, t in rows}
    clean = d.decontaminate(table.withColumn("n_hit", F.lit(0)), bench)
    assert clean.columns == ["doc_id", "text", "n_hit"]
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(brute_contamination(t, windows)[1] == 0 for t in left.values())
    assert all(left[i] == t for i, t in rows if not brute_contamination(t, windows)[1])
    assert d.contamination(table.where("false"), bench.where("false")).count() == 0
    assert d.contamination(table, bench.where("false")).where("contaminated").count() == 0


def test_contamination_does_not_depend_on_the_number_of_automata(spark, monkeypatch):
    from blockscope.llm import decontaminate as d

    words = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(words[15 * k : 15 * k + 15])) for k in range(10)] + [(20, " ".join(words[8:20])), (21, " ".join(words[150:155] + words[165:170]))]
    half, near_half = " ".join(words[:12]), " ".join(words[15:28])  # 12 and 13 of 29 words, together over 0.8
    rows = [(1, " ".join([half, "x " * 2, near_half, "y " * 2])), (None, words[0]), (None, " ".join(words[:15])), (None, " ".join(words[:15])), (2, " ".join(words[30:45])), (2, "other text " + " ".join(words[45:60]) + " end of it all here")]
    rows += [(2, "other text"), (3, " ".join(words[5:25] + ["a"] * 30)), (4, None), (5, " ".join(["b"] * 40 + words[150:155] + words[30:45] + words[165:170] + ["c"] * 40)), (6, "")]
    table = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def results():
        clean = d.decontaminate(table, bench)
        assert clean.columns == table.columns
        return Counter(map(tuple, d.contamination(table, bench).collect())), Counter(map(tuple, clean.collect()))

    whole, clean = results()
    windows = brute_windows(items, 10)
    assert Counter(r[:6] for r in whole.elements()) == Counter((i, *brute_contamination(t, windows)) for i, t in rows)
    assert not any(brute_contamination(t, windows)[4] for _, t, _ in clean.elements()) and 1 not in {r[0] for r in clean}
    for chain in (4, 2):
        monkeypatch.setattr(d, "CHAIN", chain)
        monkeypatch.setattr(d, "MAX_WORDS", 40)
        assert results() == (whole, clean)


def test_only_suspects_go_through_the_automata(spark, monkeypatch):
    from blockscope.llm import decontaminate as d

    rnd = random.Random(12)
    items = [(k, " ".join(f"i{rnd.randrange(5000)}" for _ in range(rnd.choice([1, 3, 9, 10, 30])))) for k in range(60)]
    bench = spark.createDataFrame([*items, (None, "one two"), (61, None), (62, "..")], "item_id long, text string")
    found = d.window_filter(bench, 10, "item_id", "text")
    texts = [" ".join(f"i{rnd.randrange(5000)}" for _ in range(200)) for _ in range(300)] + [f"x {t} y" for _, t in items] + ["", "one two"]
    windows = brute_windows(items, 10)
    hit = [brute_contamination(t, windows)[4] for t in texts]
    suspects = [found.may_hit(t.encode()) for t in texts]
    assert all(s for s, h in zip(suspects, hit) if h) and sum(suspects) - sum(hit) <= 2
    monkeypatch.setattr(d, "MAX_WORDS", 50)
    seen = []
    chained = d._chained
    monkeypatch.setattr(d, "_chained", lambda rows, steps: seen.append(rows.count()) or chained(rows, steps))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in d.contamination(table, bench).collect()}
    assert [got[k] for k in range(len(texts))] == hit and seen == [sum(suspects)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_token_counts_against_the_library(spark, docs, library):
    from blockscope.llm.token_counts import prefix_counts, token_counts, tokens_at, chars_within

    rows = rows_of(docs)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, TOKENIZER).collect()) == want
    assert token_counts(empty(docs), TOKENIZER).count() == 0
    short = docs.where("length(text) < 400")
    stored = prefix_counts(short, TOKENIZER).join(short.select("doc_id", "text"), "doc_id")
    for r in stored.select("text", "prefix_tokens", tokens_at(F.col("prefix_tokens"), F.lit(7)).alias("at7"), chars_within(F.col("prefix_tokens"), 5).alias("within5")).limit(40).collect():
        want = [len(library.encode(r["text"][:k], add_special_tokens=False).ids) for k in range(len(r["text"]) + 1)]
        assert r["prefix_tokens"] == want
        assert r["at7"] == want[min(7, len(want) - 1)] and r["within5"] == max(k for k, n in enumerate(want) if n <= 5)


def test_prefix_counts_of_cut_words_and_long_chunks(library):
    from blockscope.llm.token_counts import PrefixCounter

    counter, rnd = PrefixCounter(TOKENIZER), random.Random(4)
    parts = ["a", "the", "E", "'s", "'re", "'", "'v", "12", "!", "<|endoftext|>", "<|", "é", "e\u0301", "\u0130", "中", "文字", "한", "\u1112\u1161\u11ab", "Σ", " ", "क\u093c", "\u0301", "...", "x" * 9, "\x85"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        assert counter.prefixes(text) == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text
    for part in ("中文字符", "abcde,", "x", "e\u0301a", "12"):  # 20,000 characters or more without spaces
        text = part * (20_000 // len(part))
        assert counter.prefixes(text)[-1] == counter.total(text.encode())
    assert all(len(c) <= 64 for c in counter.chunks)


def test_texts_are_cut_by_prefix_counts(library):
    from blockscope.llm.token_counts import PrefixCounter

    counter, rnd = PrefixCounter(TOKENIZER), random.Random(9)
    parts = ["a", "the", "E", "'s", "'re", "12", "!", "<|endoftext|>", "é", "e\u0301", "中", "한", "क\u093c", " ", " \n", "antidisestablishment", "x" * 9]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30)))
        counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        limit = rnd.randint(0, max(counts))
        assert counter.cut(text.encode(), limit) == max(k for k, n in enumerate(counts) if n <= limit), (text, limit)


def test_packed_conversations_bind_all_three_limits(spark):
    from blockscope.llm.queries import packed_conversations

    rows = packed_conversations(spark, "/root/testdata/sf0.01").collect()
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()}
    want = {f"{c}:{t}" for (c, t), r in turns.items() if r["role"] == "assistant" and (c, t - 1) in turns and turns[c, t - 1]["role"] == "user"}
    assert {r["example"] for r in rows} == want
    sequences = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        for k, n in enumerate((r["length"], 1, r["loss_tokens"])):
            sequences[r["sequence_id"]][k] += n
    assert all(n <= 2048 and m <= 12 and loss <= 1024 for n, m, loss in sequences.values())
    assert max(loss for _, _, loss in sequences.values()) == 1024 and max(m for _, m, _ in sequences.values()) == 12


def test_every_token_is_its_own_encoding():
    from blockscope.llm.token_counts import PrefixCounter

    counter = PrefixCounter(TOKENIZER)
    assert all(counter._merge(counter._symbols(t)) == [t] for t in counter.vocab)


@pytest.mark.parametrize("segments,loss", [(256, None), (3, 900)])
def test_packing(spark, docs, library, segments, loss):
    from blockscope.llm.packing import pack

    rows = Counter((i, t or "") for i, t in rows_of(docs))
    got = pack(docs, TOKENIZER, max_segments=segments, max_loss=loss, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))
    for (i, t), n in rows.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        own = sorted((r for r in pieces[i] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == (ids * n if len(ids) <= 2048 and n == 1 else sorted(ids * n, key=ids.index) if n > 1 and len(own) > n else ids * n)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))]
        assert total <= 2048 and len(s) <= segments and sum(r["loss_tokens"] for r in s) <= (loss or 2048)
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    if loss is None:
        assert padding == 0
    assert pack(empty(docs), TOKENIZER).count() == 0


def test_packing_keeps_pieces_of_bins_that_the_pool_cannot_fill(spark):
    from blockscope.llm.packing import pack

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b").alias("text")).coalesce(1)
    got = pack(docs, TOKENIZER, max_segments=4096, capacity=8192).collect()
    assert sorted(r["doc_id"] for r in got if r["start"] == 0) == list(range(6000))
    assert sum(r["length"] for r in got) == 6000 + 2 * 2000


def test_packing_counts_prompts_as_free_of_loss(spark):
    from blockscope.llm.packing import pack

    rows = spark.createDataFrame([(1, "a b c d", 3), (2, "a b", None), (3, None, 9)], "doc_id long, text string, prompt int")
    got = {r["doc_id"]: (r["doc_tokens"], r["loss_tokens"]) for r in pack(rows, TOKENIZER, prompt_tokens_col="prompt").groupBy("doc_id").agg(F.max("doc_tokens").alias("doc_tokens"), F.sum("loss_tokens").alias("loss_tokens")).collect()}
    assert got == {1: (5, 2), 2: (3, 2), 3: (1, 0)}


def test_connected_components(spark):
    from blockscope.llm.graph import connected_components

    chain = [(k, k + 1) for k in range(50)] + [(100, 102), (102, 101), (7, 3), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
