"""Operators 11 to 13 against plain versions, on the smallest tables and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import chat_format, conversation_repair, filter_audit
from assaykit.llm.digests import chat_digests, repair_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("conv_id bigint, turn bigint, role string, text string, key string, edit string, "
          "block string, position string")          # the last four clash with outputs


def turns(rows):
    return [(*r, "k", "e", "b", "p") for r in rows]


@pytest.fixture(scope="module")
def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeats, ties, empty and very long texts, unknown roles, long runs."""
    rng = random.Random(3)
    rows = [(1, 0, "user", None), (1, None, None, "x."), (1, 1, "", "y."), (1, 1, "tool", "z"),
            (None, 0, "user", "hi."), (None, 1, "assistant", "there."), (2, 5, "system", "s."),
            (3, 0, "user", "a."), (3, 0, "user", "a."), (3, 2, "assistant", "b" * 100000 + "."),
            (4, 0, "assistant", "<|im_sep|><\\|<\\\\| x."), (4, 1, "user<|im_end|>", "\x85 a.\x85"),
            (5, 0, "user", "  \t\n"), (6, 0, "user", "éà 🙂🙂 ñ. "), (6, 9, "assistant", "🙂<")]
    for c in range(7, 60):
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["system", "user", "assistant", "tool", "user",
                                                             "assistant"]),
                  rng.choice(["a.", "b!", "c", "d?", "", "e", f"{t}."])) for t in range(rng.randrange(12))]
    return spark.createDataFrame(turns(rows), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def grouped(rows):
    """Turns by conversation in the stated order."""
    out = collections.defaultdict(list)
    for r in rows:
        out[r.conv_id].append(r)
    for own in out.values():
        own.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.text))
    return out


# 11

def plain_repair(own):
    """Counts, cost and edit letters by a search over whole strings from the end."""
    seen, kinds, n = set(), [], collections.Counter()
    for _, role, text in own:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
        n[fault] += 1
        kinds.append((role[:1], fault))
    go = {"": "su", "s": "u", "u": "a", "a": "u"}
    rest = {q: {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}[q] for q in go}
    for initial, fault in reversed(kinds):
        cut, taken = int(fault == "truncated"), {}
        for q in go:
            ways = [(3 + rest[q][0], "D" + rest[q][1])]
            if fault not in ("blank", "duplicate"):
                if initial and initial in go[q]:
                    ways.append((cut + rest[initial][0], "K" + rest[initial][1]))
                ways += [(2 + cut + rest[r][0], "R" + rest[r][1]) for r in "ua" if r in go[q]]
            taken[q] = min(ways)
        for _ in range(4):
            taken = {q: min([taken[q], *[(2 + taken[r][0], "I" + taken[r][1])
                                         for r in "ua" if r in go[q]]]) for q in go}
        rest = taken
    at = [t for t, _, _ in own if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
    cost, audit = rest[""]
    out, k = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else own[k][1:]
        k += letter != "I"
        if letter in "IR":
            role = "user" if not out or out[-1][0][:1] in ("a", "s") else "assistant"
        if letter != "D":
            out.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)


def plain_damage(rows):
    for r in rows:
        conv, turn, role, text = (" " if v is None else v for v in r[:4])
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if fault == 4:
            role = "user"
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for _ in range({0: 0, 3: 2}.get(fault, 1)):
            yield r[0], r[1], role, text


@pytest.mark.parametrize("table", ["conversations", "odd", "none"])
@pytest.mark.parametrize("held", [1 << 16, 0, 5])
def test_repair(request, monkeypatch, table, held):
    df = request.getfixturevalue(table)
    Turn = collections.namedtuple("Turn", "conv_id turn role text")
    want = {c: plain_repair([t[1:] for t in own])
            for c, own in grouped(Turn(*t) for t in plain_damage(df.collect())).items()}
    got = repair_digests(conversation_repair.repair(conversation_repair.damaged(df), held_turns=held)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_blocks_of_backpointers():
    """A conversation cut into many blocks is traced as if held whole."""
    rng = random.Random(8)
    rows = [(1, str(t), r := rng.choice(["user", "assistant", "tool", "system"]), r[0], rng.choice("oxtd"))
            for t in range(500)]
    own = conversation_repair.Conversation("1")
    for _, t, role, initial, fault in rows:
        own.take(t, initial, fault)
        own.turns.append((role, "x"))
    whole = [e[3] for e in own.edits()][:-1]
    state, pieces = conversation_repair.ending(own.states)[1], []
    back = bytes(own.back)
    tail = ["I"] * conversation_repair._TO_END[state]
    for at in range(len(back) - len(back) % 28, -1, -28):
        piece, state = conversation_repair.traced(back[at:at + 28], state)
        pieces = ["".join(p[0] for p in piece)] + pieces
    assert list("".join(pieces)) + tail == whole


def test_states_are_few():
    """Ways that can never win go, so long conversations need no new states."""
    kinds = [a + b for a in "sua-" for b in "xot"]
    seen, todo = {conversation_repair.START}, [conversation_repair.START]
    while todo:
        states = todo.pop()
        for kind in kinds:
            after = conversation_repair.step(states, kind)[0]
            if after not in seen:
                seen.add(after)
                todo.append(after)
    assert len(seen) < 2000


# 12

def plain_audit(docs, labels):
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    marks = {k: {x.doc_id for x in labels if x[k] == 1 and x.doc_id is not None} for k in ("quality", "toxic")}
    parts = collections.defaultdict(list)
    for r in docs:
        t = r.text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
             "C": 100 * sum(c in filter_audit.CAPITALS for c in t) > 10 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and first[t] < r.doc_id}
        parts[r.lang or ""].append(({k for k, v in f.items() if v}, r.doc_id in marks["quality"],
                                    r.doc_id in marks["toxic"]))
    out, shapley = {}, collections.Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                    sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("table", ["real", "odd_docs", "no_docs"])
def test_filter_audit(request, spark, sf_dir, table):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = (spark.read.parquet(f"{sf_dir}/documents.parquet") if table == "real"
            else request.getfixturevalue(table))
    # repeated labels, a null id, extra columns
    labels = (labels.union(labels.select("doc_id", F.lit(1), F.lit(None).cast("int")).limit(9))
              .union(spark.createDataFrame([(None, 1, 1)], labels.schema)).withColumn("mask", F.lit("m")))
    got = filter_audit.audit(docs.withColumn("digest", F.lit("d")), labels).collect()
    want = plain_audit(docs.collect(), labels.collect())
    assert len(got) == len(want)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


# 13

@pytest.mark.parametrize("table", ["conversations", "odd", "none"])
@pytest.mark.parametrize("block", [1 << 20, 1])
def test_chat_format(request, table, block):
    df = request.getfixturevalue(table)
    out = chat_format.chat_format(df, block_chars=block)
    rows = out.orderBy("conv_id", "block").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
    tok = chat_format.tokenizer(chat_format.default_path())
    want = grouped(r._replace(role=r.role or "", text=r.text or "") for r in map(
        lambda r: collections.namedtuple("T", "conv_id turn role text")(*r[:4]), df.collect()))
    assert set(by) == set(want)
    digests = {r.conv_id: r for r in chat_digests(out).collect()}
    for conv, own in want.items():
        text = "".join(r.formatted for r in by[conv])
        assert chat_format.parse(text) == [(t.role, t.text) for t in own]
        ids = [i for r in by[conv] for i in r.token_ids]
        assert ids == tok.encode(text, add_special_tokens=False).ids       # cut or not
        assert tok.decode(ids, skip_special_tokens=False) == text
        spans = [(a, b, m) for r in by[conv] for a, b, m in zip(r.token_starts, r.token_ends, r.loss_mask)]
        learned = sorted({i for a, b, m in spans if m for i in range(a, b)})
        said = [t.text for t in own if t.role == "assistant"]
        assert "".join(text[i] for i in learned) == "".join(map(chat_format.escape, said))
        d = digests[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(own), len("".join(said)), len(text))
        assert d.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(
            f"{t.role}\n{t.text}\n" for t in own).encode()).hexdigest()


def test_escapes_are_reversible():
    for n in range(1, 7):
        for s in map("".join, itertools.product("<\\|a", repeat=n)):
            e = chat_format.escape(s)
            assert "<|" not in e and chat_format.unescape(e) == s


def test_mask_is_exact_for_tokens_over_edges():
    """A token that reaches over the edge of a span has no loss."""
    starts, ends = np.array([0, 2, 4, 4, 5, 9]), np.array([2, 4, 5, 5, 9, 9])
    assert chat_format.loss_mask(starts, ends, [(2, 5)]).tolist() == [False, True, True, True, False, False]
    assert chat_format.loss_mask(starts, ends, [(3, 5), (5, 8)]).tolist() == [False, False, True, True, False, False]
    assert not chat_format.loss_mask(starts, ends, [(4, 4), (3, 4)]).any()
