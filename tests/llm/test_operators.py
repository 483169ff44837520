"""Each operator against a plain rule, on the smallest tables and on odd rows."""

import collections
import hashlib
import math
import random
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.llm import (exact_dedup, fingerprints, jaccard_join, language_id, language_model,
                          mixing, packing, token_counts, toxicity, url_filters)
from assaykit.llm.shared import components, written
from assaykit.llm.tokens import default_path
from assaykit.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# 1

@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_exact_groups(request, table):
    df = request.getfixturevalue(table)
    rows, out = texts(df), exact_dedup.exact_groups(df).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(out) == len(rows)
    for r in out:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
    kept = collections.Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == set(groups)
    assert exact_dedup.deduplicate(df).count() == len(groups)


def test_weak_digests_do_not_join_texts(docs):
    weak = exact_dedup.exact_groups(docs, lambda raw: bytes([len(raw) % 3])).collect()
    full = exact_dedup.exact_groups(docs).collect()
    assert {(r.doc_id, r.keep_id) for r in weak} == {(r.doc_id, r.keep_id) for r in full}


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 255, 200000).astype(np.uint8)
    places = exact_dedup.cuts(x)
    moved = exact_dedup.cuts(np.append(rng.integers(0, 255, 777).astype(np.uint8), x))
    assert set((places + 777).tolist()) <= set(moved.tolist())
    ends = exact_dedup.chunk_ends(places, 0, x.size)
    assert ends[-1] == x.size and max(np.diff([0, *ends])) <= exact_dedup.MAX_CHUNK


# 2

@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_fingerprints(request, table):
    df = request.getfixturevalue(table)
    rows = texts(df)
    out = fingerprints.fingerprints(df).collect()
    assert len(out) == len(rows)
    if table != "docs":
        return
    rows.sort(key=lambda r: -r[0])
    following = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    own = dict(rows)
    for r in out:
        text = own[r.doc_id]
        k = len(text) // 3
        edited = text[:len(text) - k] + following[r.doc_id][:k]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.encode(fingerprints.digest(text.encode()))
        codes = fingerprints.decode(r.edited_fingerprint)
        assert (codes == fingerprints.digest(edited.encode())).all()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited > r.near_next for r in out]) > 0.9


# 3

def test_token_rollups(spark, docs, odd_docs, no_docs):
    tok = Tokenizer.from_file(default_path())
    for df in (docs.limit(60), odd_docs):
        rollups = token_counts.TokenRollups(spark, scratch_path(spark, "rollups"))
        rows = df.select("doc_id", "text", "source", "lang")
        rollups.commit(1, rows.withColumn("op", F.lit("insert")))
        changed = rows.where("doc_id % 3 < 2").withColumn(
            "op", F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("revise")).withColumn(
            "text", F.concat("text", F.lit(" more"))).dropDuplicates(["doc_id"])
        for _ in range(3):
            rollups.commit(2, changed)
        want = collections.Counter()
        plan = [r for r in rows.collect() if r.doc_id is None or r.doc_id % 3 == 2]
        plan += [r for r in changed.collect() if r.op == "revise"]
        for r in plan:
            n = {"words": len(words(r.text)), "word_bpe_49k": len(tok.encode(
                r.text or "", add_special_tokens=False).ids)}
            for version, tokens in n.items():
                want[(r.source, r.lang, version, "docs")] += 1
                want[(r.source, r.lang, version, "tokens")] += tokens
        got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in rollups.totals().collect()
               for c in ("docs", "tokens") if r[c]}
        assert got == {k: v for k, v in want.items() if v}
    empty = token_counts.TokenRollups(spark, scratch_path(spark, "rollups"))
    assert empty.totals().count() == 0
    empty.commit(1, no_docs.select("doc_id", "text", "source", "lang").withColumn("op", F.lit("insert")))
    assert empty.totals().count() == 0


# 4

def test_toxicity_learns_and_holds_out(spark):
    rude = ["scumbag", "moronic", "idiotism"]
    base = [f"{a}{b}" for a in ("ber", "tol", "min", "sar") for b in ("en", "ol", "is", "at")]
    rng = np.random.default_rng(3)

    def text(toxic):
        w = [base[k] for k in rng.integers(0, len(base), 60)]
        if toxic:
            for k in rng.integers(0, 60, 4):
                w[k] = rude[int(rng.integers(0, 3))]
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"),
                         ~toxicity.held_out())
    out = {r.doc_id: r for r in toxicity.score(df, model).withColumn(
        "h", toxicity.held_out()).where("h").collect()}
    assert len(out) > 100
    assert all(out[i].predicted == t for i, _, t in rows if i in out)


def test_toxicity_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 1), (8, 0), (None, 1), (9, None)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels, F.lit(True))
    out = toxicity.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels, F.lit(True))).count() == 0


# 5

def test_url_filter_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/a/?utm_source=x&b=2&a=1#f",
            "http://x.net", "http://example.net/en", "http://a.example.com/de/x", "ftp://net/",
            "http://b.org/fr/?ref=1", "http://casino.b.org/p/", "https://www.casino.b.org/p?ref=q",
            "http://a.com?x://y"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, rule string")
    out = {r.page_id: r for r in url_filters.judge(pages, url_filters.listed_urls(pages)).collect()}
    assert len(out) == len(urls)
    assert [(out[i].host, out[i].path, out[i].rule) for i in range(4)] == [("", "", None)] * 4
    assert (out[4].host, out[4].rule, out[4].canonical) == (
        "www.example.net", "example.net/en/", "example.net/en/a?a=1&b=2")
    assert (out[5].rule, out[6].rule, out[7].rule) == (None, "net/", "example.com/de/")
    assert (out[8].verdict, out[9].rule) == ("block", "org/fr/")
    assert out[10].listed and out[11].listed and out[11].verdict == "block"
    assert out[12].host == "a.com" and out[12].path == ""
    assert url_filters.judge(pages.limit(0), url_filters.listed_urls(pages)).count() == 0
    assert not any(r.listed for r in url_filters.judge(pages, pages.limit(0).select("url")).collect())


# 6

def test_language_id(docs, odd_docs, no_docs):
    model = language_id.fit(docs, ~language_id.held_out())
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn(
        "h", language_id.held_out()).where("h").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    odd = language_id.identify(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    for r, (_, t) in zip(odd, texts(odd_docs)):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t))
        assert 0 <= r.score <= 1
    nothing = language_id.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0
    assert language_id.keep_identified(odd_docs, model).columns == odd_docs.columns


# 7

def plain_components(rows, width, num, den):
    sets = [frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1)))
            if (w := words(t)) else frozenset() for _, t in rows]
    least = list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    key = [math.inf if i is None else i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = key[a] == key[b] and key[a] != math.inf
            n = len(sets[a] & sets[b])
            link = sets[a] and sets[b] and den * n >= num * (len(sets[a]) + len(sets[b]) - n)
            if same or link:
                x, y = sorted((find(a), find(b)), key=lambda i: key[i])
                least[y] = x
    return [rows[find(k)][0] for k in range(len(rows))], sets


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
@pytest.mark.parametrize("rule", [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_jaccard_components(request, table, rule):
    df = request.getfixturevalue(table)
    if rule[0] == 1:
        df = df.withColumn("text", F.substring("text", 1, 200))
    rows = texts(df)
    want, sets = plain_components(rows, *rule)
    out = jaccard_join.jaccard_components(df, *rule).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted(
        (str(i), len(s), str(c)) for (i, _), s, c in zip(rows, sets, want))


def test_near_group_without_one_centre(spark):
    """A large group whose members mostly do not link to its first one."""
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 3))):
            w[k] = f"v{rng.integers(0, 4)}"
        rows.append((i, " ".join(w)))
    want, _ = plain_components(rows, 3, 90, 100)
    out = jaccard_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert {r.doc_id: r.component_id for r in out.collect()} == dict(zip(range(240), want))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [
        (500 + k, 501 + k) for k in range(40)]
    least = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    out = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in out.collect()} == least


# 8

@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_mixture(request, table):
    df = request.getfixturevalue(table)
    mix = written(mixing.mixture(df), "mix")
    out = mix.join(df.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert mix.count() == df.count()
    by = collections.defaultdict(list)
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.target <= 2 * r.source_size + 1e-6
        by[r.source].append(r)
    if table == "docs":
        total = sum(r.size for r in out)
        assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-3
        for v in by.values():
            # whole documents: what is missing is less than any document that may come once more
            missing = v[0].target - sum(r.taken for r in v)
            most = 2 if v[0].target >= v[0].source_size else 1
            left = [r.size for r in v if r.copies < most and r.size]
            assert missing >= 0 and (not left or missing < min(left))
    assert mixing.mixed(df).count() == sum(r.copies for r in mix.collect())


# 9

@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_language_model(request, table):
    df = request.getfixturevalue(table)
    held = language_model.held_out()
    rows = [(i, [*words(t), None]) for i, t in texts(df)]
    train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    out = sorted(language_model.score(df, ~held).collect(), key=lambda r: r.row_id)
    assert len(out) == len(rows)
    for r, (i, w) in zip(out, rows):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (
            i, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    if table == "docs":
        own = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_automaton_is_a_distribution():
    frequent = np.array([10, 20, 30])
    root = np.log10([0.5, 0.3, 0.1])
    m = language_model.automaton(frequent, np.array([50, 30, 10]), root,
                                 np.array([0 * 3 + 1, 0 * 3 + 2, 1 * 3 + 0]), np.array([20, 5, 9]))
    for state in range(3):
        p = [10 ** (m.walk([state, w]) - m.walk([state])) for w in range(3)]
        rare = 10 ** (m.walk([state, -1]) - m.walk([state])) * 0.1    # what the root leaves to others
        assert sum(p) + rare == pytest.approx(1)


@pytest.mark.parametrize("cache", [0, 40, 1 << 20])
def test_language_model_keeps_every_pair(spark, cache):
    """Rare pairs have arcs however little the tasks hold: the same scores as one machine."""
    rng = random.Random(4)
    common = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.9 else f"rare{rng.randrange(150)}"
                         for _ in range(rng.randrange(60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = language_model.held_out()
    seqs = [[*words(t), None] for _, t in rows]
    train = [s for s, (i, _) in zip(seqs, rows) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for s in train for x in s)
    pairs = collections.Counter(p for s in train for p in zip(s, s[1:]))
    names = sorted({x for s in seqs for x in s}, key=str)
    ids = {x: k for k, x in enumerate(names)}
    n, sizes = sum(c.values()), collections.Counter(c.values())
    root = language_model.root_of(n, len(c), [sizes[k + 1] for k in range(language_model.KATZ + 1)])

    def at_root(k):
        return math.log10(root.unseen if k == 0 else root.star[k - 1] / n
                          if k <= language_model.KATZ else k * root.rest / n)

    kept = {p: k for p, k in pairs.items() if k >= 2}
    assert any(k == 2 for k in kept.values())
    m = language_model.automaton(
        np.arange(len(names)), np.array([c[x] for x in names]),
        np.array([at_root(c[x]) for x in names]),
        np.array([ids[a] * len(names) + ids[b] for a, b in kept]), np.array(list(kept.values())))
    got = {r.doc_id: r.score for r in language_model.score(df, ~held, cache).collect()}
    for s, (i, _) in zip(seqs, rows):
        assert got[i] == pytest.approx(m.walk([ids[x] for x in s]), abs=1e-9)


# 10

@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    tok = Tokenizer.from_file(default_path())
    want = collections.Counter()
    ids_of = collections.defaultdict(list)
    for i, t in texts(df):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        ids_of[(i, len(ids))] = ids
        want[(i, len(ids))] += len(ids)
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for r in packing.pack(df, group_tokens=1 << 16).collect():
        ids = ids_of[(r.doc_id, r.doc_tokens)][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) and r.length == len(ids)
        got[(r.doc_id, r.doc_tokens)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 4096 and end & (end - 1) == 0


def plain_balanced(lengths, length, scale=2048.0):
    """The packing rule by looking at every sequence for every piece."""
    rooms = packing.capacities(sum(lengths), length)
    used, cost, out = [0] * len(rooms), [0.0] * len(rooms), []
    pieces = []
    for d, n in enumerate(lengths):
        pieces += [(length, d, s) for s in range(0, n - length + 1, length)]
        pieces += [(n % length, d, n - n % length)] if n % length else []
    while pieces:
        piece = min(pieces, key=lambda p: (-p[0], p[1], p[2]))
        pieces.remove(piece)
        n, d, start = piece
        fits = [s for s in range(len(rooms)) if rooms[s] - used[s] >= n]
        if fits:
            s, part = min(fits, key=lambda s: (cost[s], s)), n
        else:
            s = min(range(len(rooms)), key=lambda s: (used[s] - rooms[s], cost[s], s))
            part = rooms[s] - used[s]
            pieces.append((n - part, d, start + part))
        out.append((d, start, part, s, used[s]))
        used[s] += part
        cost[s] += packing.attention_cost(part, scale)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_packing_takes_the_cheapest_of_all_sequences(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, rng.randrange(1, 9), rng.randrange(1, 64), rng.randrange(1, 400)])
               for _ in range(rng.choice([0, 1, 5, 120]))]
    assert packing.balanced(lengths, 64) == plain_balanced(lengths, 64)


def test_rows_that_share_an_id_stand_for_themselves(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(3, a, "x"), (9, a + " more", "y"), (9, b, "z"), (None, b + " more", "n"), (None, "alone", "m"),
            (3, "", "e"), (3, "", "f")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, size string").coalesce(1), "ids")
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.size for r in got.collect()) == ["e", "f", "m", "x", "z"]


def test_a_replayed_batch_without_rows_takes_its_rows_back(spark, docs):
    rollups = token_counts.TokenRollups(spark, scratch_path(spark, "rollups"))
    some = docs.where("doc_id % 3 = 0").withColumn("op", F.lit("insert"))
    rollups.commit(1, some)
    one = sorted(map(str, rollups.totals().collect()))
    rollups.commit(2, docs.where("doc_id % 3 = 1").withColumn("op", F.lit("insert")))
    assert sorted(map(str, rollups.totals().collect())) != one
    rollups.commit(2, some.where("false"))
    assert sorted(map(str, rollups.totals().collect())) == one
    rollups.commit(3, some.withColumn("op", F.lit("delete")))
    assert {r.docs for r in rollups.totals().collect()} == {0}


def test_only_possible_hits_are_joined(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select((F.col("id") % 50).cast("string").alias("u"))
        listed = spark.createDataFrame([("7",), ("nowhere",)], "u string")
        got = url_filters.listed_hits(rows, "u", listed)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.u, r.listed) for r in got.collect()} == {(str(i), i == 7) for i in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Union" in plan and "_ask" not in plan and got.count() == 500


# 4, by dictionaries of letters

def letters_of_text(text):
    return "".join("\0" + "".join(w) for w in re.findall(r"[^\W\d_]+", text.lower()))


def plain_kneser_ney(texts_of, d, order=4):
    """(probability of a letter after three, by class; share left to lower orders; vocabulary)."""
    tops = {c: collections.Counter(s[i:i + order] for s in map(letters_of_text, ts)
                                   for i in range(len(s) - order + 1)) for c, ts in texts_of.items()}
    counts = {order: set(tops[0]) | set(tops[1])}
    conts = {}
    for k in range(order - 1, 0, -1):
        conts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        counts[k] = set(conts[k])
    total, seen = sum(conts[1].values()), len(conts[1])

    def shared(g):
        if not g:
            return 1 / (seen + 1)
        if len(g) == 1:
            return max(conts[1][g] - d, 0) / total + d * seen / total * shared("")
        own = {h: n for h, n in conts[len(g)].items() if h[:-1] == g[:-1]}
        t = sum(own.values())
        if not t:
            return shared(g[1:])
        return max(own.get(g, 0) - d, 0) / t + d * len(own) / t * shared(g[1:])

    def left(c, context):
        own = [n for h, n in tops[c].items() if h[:-1] == context]
        return d * len(own) / sum(own) if own else 1.0

    def p(c, g):
        t = sum(n for h, n in tops[c].items() if h[:-1] == g[:-1])
        return (max(tops[c][g] - d, 0) / t if t else 0) + left(c, g[:-1]) * shared(g[1:])

    return p, left, set(conts[1]), counts[order]


TOXIC_TEXTS = {0: ["a calm day, a calm sea", "the sea and the day", "Über dem See", "end"],
               1: ["calm down you fool", "fool fool day", "the foul sea"]}


def test_kneser_ney_equals_a_plain_version():
    d = toxicity.DISCOUNT
    p, left, vocabulary, grams = plain_kneser_ney(TOXIC_TEXTS, d)
    for c in (0, 1):
        for context in {g[:-1] for g in grams}:      # all letters, and the one never seen
            assert sum(p(c, context + w) for w in [*vocabulary, "?"]) == pytest.approx(1)
    rows = [(c, t) for c, ts in TOXIC_TEXTS.items() for t in ts]
    batch = pa.record_batch({"toxic": pa.array([c for c, _ in rows], pa.int32()),
                             "text": pa.array([t for _, t in rows])})
    model = toxicity.build(pa.Table.from_batches(toxicity._count(iter([batch]), 4)).to_pandas())
    assert len(model.keys) == len(grams)
    for text in ["the calm fool", "a foul day", "xyz you", "you qqq", "Über", "ab"]:
        s = letters_of_text(text)
        want = 0.0
        for g in (s[i:i + 4] for i in range(len(s) - 3)):
            if g in grams:
                want += math.log(p(1, g) / p(0, g))
            else:
                want += math.log(left(1, g[:-1]) / left(0, g[:-1]))
        n = max(0, len(s) - 3)
        assert model.evidence([text])[0] == pytest.approx(want / (n + toxicity.PRIOR_LENGTH))
