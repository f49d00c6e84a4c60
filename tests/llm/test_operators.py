"""Each operator against a brute-force version on small documents with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import io
import json
import os
import random
import re
import struct
import time
import wave
import zlib

import numpy as np
import pytest

from lexforge.llm import bpe, chat, components, exact, langid, lines, media, mixing, near, shards, suffix
from lexforge.llm.common import Tables, shingle_sets, utf8
from lexforge.llm.queries import vocabulary

WORDS = "the of and in to nd thing ere tion about which Über straße año être".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, line string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = "\n".join(sentence(rng, 12) for _ in range(12))
    out = [(1, base), (2, base), (3, base.replace("1", "x", 2)), (4, " ".join(base.split())), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "One"), (10, "one two three")]
    out += [(10 + i, sentence(rng, 40) + "\n" + base[:500] + "\n" + sentence(rng, 30)) for i in range(1, 6)]
    out += [(20, "ab" * 400), (21, "ab" * 300 + "c"), (22, "日本語テキスト 😀 " * 40), (23, sentence(rng, 9000)), (1, base), (None, base), (None, "lost " * 60), (24, base + " tail"), (25, "don't  stop\r\n\x0b it's  42nd.")]
    return [(i, t, ("en", "de", "fr", None)[k % 4], ("s1", "s2", None)[k % 3], 0, "x", "y") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(t):
    return t or ""


def order(i):
    return 2**63 - 1 if i is None else i


# ---------------------------------------------------------------- 1


def brute_suffix(pairs, n=100):
    seen, out = set(), {}
    for key in sorted({(order(i), t) for i, t in pairs}, key=lambda k: (k[0], k[1])):
        b = key[1].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(b[s : s + n])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[key] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("wide,heavy", [(1000, 20_000), (1, 20_000), (1000, 2)])
def test_suffix(spark, docs, wide, heavy, monkeypatch):
    monkeypatch.setattr(suffix, "HEAVY", heavy)
    if heavy == 2:  # ranks of two anchors are split, and each is seen
        monkeypatch.setattr(suffix, "SAMPLE", 1)
    plain = suffix.starts
    monkeypatch.setattr(suffix, "starts", lambda d, length: plain(d, length, wide))
    # texts of one id come in order of a hash, so the brute-force version gets one text an id
    one = docs.where("doc_id is not null or text like 'lost%'")
    want = brute_suffix([(i, text(t)) for i, t, *_ in rows() if i is not None or text(t).startswith("lost")])
    got = sorted((order(r[0]), *r[1:]) for r in suffix.digests(one).collect())
    assert got == sorted((order(i), *want[(order(i), text(t))]) for i, t, *_ in rows() if i is not None or text(t).startswith("lost"))


def test_suffix_random(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(40, 400))) for _ in range(12)]
    pairs = [(i, "".join(rng.choice(parts)[rng.randrange(30) :] for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    d = spark.createDataFrame(pairs, "doc_id long, text string")
    want = brute_suffix(pairs)
    assert sorted(map(tuple, suffix.digests(d).collect())) == sorted((i, *want[(i, t)]) for i, t in pairs)


def test_suffix_byte_between_anchors(spark):
    """Texts that differ in one byte only, where strings of half the length at anchors that are far apart leave it out."""
    rng, pairs, planted = random.Random(11), [], 0
    while planted < 6:
        t = bytearray(rng.choice(b"abcdefghij ") for _ in range(500))

        def low(t):
            h = suffix.order_of(suffix.strings(np.frombuffer(bytes(t), np.uint8), 50)) >> suffix.PLACE
            return [s + int(h[s : s + 51].argmin()) for s in range(len(t) - 99)]

        before = low(t)
        for s in np.flatnonzero(np.diff(before) == 51):
            u = bytearray(t)
            u[before[s] + 50] = ord("x")
            now = low(u)
            if (now[s], now[s + 1]) == (before[s], before[s + 1]):
                pairs += [(len(pairs), t.decode()), (len(pairs) + 1, u.decode())]
                planted += 1
                break
    want = brute_suffix(pairs)
    assert sorted(map(tuple, suffix.digests(spark.createDataFrame(pairs, "doc_id long, text string")).collect())) == sorted((i, *want[(i, t)]) for i, t in pairs)


@pytest.mark.parametrize("length", [4, 60, 200, 1000])
def test_suffix_of_other_lengths(spark, length):
    rng = random.Random(length)
    words = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 400))) for _ in range(6)]
    pairs = [(i, "".join(rng.choice([w, w[rng.randrange(len(w)) :], "=" * rng.randrange(2500), f"own {i} {rng.random()}"]) for w in rng.sample(words, 3))) for i in range(25)]
    want = brute_suffix(pairs, length)
    assert sorted(map(tuple, suffix.digests(spark.createDataFrame(pairs, "doc_id long, text string"), length).collect())) == sorted((i, *want[(i, t)]) for i, t in pairs)


def test_suffix_odd_tables(spark, none):
    assert suffix.digests(none).count() == 0
    with pytest.raises(ValueError):
        suffix.digests(none, 3)
    short = spark.createDataFrame([(1, None), (2, "x"), (None, "")], "doc_id long, text string")
    assert sorted((order(r[0]), *r[1:4]) for r in suffix.digests(short).collect()) == [(1, 0, 0, 0), (2, 1, 0, 0), (2**63 - 1, 0, 0, 0)]


def test_long_texts_in_pieces(monkeypatch):
    """Anchors of a text are the same whether it is read at once or in pieces."""
    data = np.random.default_rng(3).integers(97, 101, 60_000).astype(np.uint8)
    data[20_000:30_000] = 61
    whole = suffix.anchors(data, np.array([0, len(data)]), 100)
    at = suffix.rolling_at(data, 51, 12, whole[1])
    monkeypatch.setattr(suffix, "STEP_BYTES", 7_000)
    for x, y in zip(whole, suffix.anchors(data, np.array([0, len(data)]), 100), strict=True):
        assert (x == y).all()
    assert (suffix.rolling_at(data, 51, 12, whole[1]) == at).all() and (at == suffix.rolling(data, 51, 12)[whole[1]]).all()


def test_numbers_by_order():
    """Sorted keys in batches of any size: equal ones get one number in ascending order, unique ones leave."""
    import pyarrow as pa

    rng = random.Random(2)
    for size in (1, 2, 3, 50):
        keys = sorted((rng.randrange(9), rng.randrange(3)) for _ in range(40))
        t = pa.table({"k": [k for k, _ in keys], "l": [v for _, v in keys], "dn": list(range(40))})
        out = [r for b in suffix._numbered(["k", "l"])(iter(t.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        shared = [k for k in keys if keys.count(k) > 1]
        assert [(r["k"], r["l"]) for r in out] == shared and [r["first"] for r in out] == [i == 0 or shared[i - 1] != k for i, k in enumerate(shared)]
        by = {}
        for r in out:
            by.setdefault((r["k"], r["l"]), set()).add(r["n"])
        assert all(len(v) == 1 for v in by.values()) and [min(by[k]) for k in sorted(by)] == sorted(set().union(*by.values()))


@pytest.mark.parametrize("length", [20, 21, 100, 101])
def test_anchors_leave_no_byte_out(length):
    data = np.random.default_rng(3).integers(97, 107, 200_000).astype(np.uint8)
    _, a, _, _, _ = suffix.anchors(data, np.array([0, len(data)]), length)
    assert np.diff(a).max() <= suffix.gram_size(length)


# ---------------------------------------------------------------- 2


def encoder():
    import base64

    import tiktoken

    pytest.importorskip("public_tokenizers")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs):
    own = encoder()
    got = sorted((order(r[0]), *r[1:]) for r in bpe.digests(docs, vocabulary()).collect())
    want = []
    for i, t, *_ in rows():
        ids = own.encode_ordinary(text(t))
        want.append((order(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text(t).encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_pieces_and_special_strings():
    own, codec = encoder(), bpe.Codec.at(vocabulary())
    rng = random.Random(1)
    for t in [sentence(rng, 60_000), "x" * 200_000, "<|endoftext|> a<|endoftext|>", " " * 70_000 + "a  b" * 40_000, "é😀\n \n" * 30_000]:
        assert codec.encode([t])[0] == own.encode_ordinary(t)
        assert codec.decode(codec.encode([t])[0]).decode() == t
    t = "naïve 😀 text"
    ids = codec.encode([t])[0]
    assert codec.byte_spans(ids)[-1][1] == len(t.encode()) and codec.offsets(t)[0][0] == 0 and codec.offsets(t)[-1][1] == len(t)


def test_bpe_frames(docs):
    e = bpe.encoded(docs, vocabulary())
    assert set(docs.columns) < set(e.columns)
    back = bpe.decoded(e, vocabulary())
    assert all(bytes(r["decoded"]).decode() == text(r["text"]) for r in back.collect())
    assert all(r["decodes"] for r in bpe.round_trip(docs, vocabulary()).collect())


# ---------------------------------------------------------------- 3


def test_sharding(docs, none):
    names = [f"n{i}" for i in range(7)]
    table = shards.lookup(names, 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1 and len(table) == 101
    # brute force: the same turns, each shard's whole order of preference written out
    want, free = [None] * 101, set(range(101))
    prefs = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % 101, int.from_bytes(d[8:16], "big") % 100 + 1
        prefs.append([(start + j * step) % 101 for j in range(101)])
    while free:
        for s, p in enumerate(prefs):
            if free:
                slot = next(x for x in p if x in free)
                want[slot] = s
                free.remove(slot)
    assert table.tolist() == want
    got = shards.place(docs, docs["doc_id"], names, 101).collect()
    assert len(got) == len(rows()) and all(names[table[r["slot"]]] == r["shard"] for r in got)
    fewer = shards.lookup(names[:-1], 101)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 40
    assert shards.place(none, none["doc_id"], names, 101).count() == 0
    with pytest.raises(ValueError):
        shards.lookup(["a", "a"])
    assert np.bincount(shards.lookup(["a", "b"], 101, [3, 1])).tolist() in ([76, 25], [75, 26])


# ---------------------------------------------------------------- 4


def test_chat(spark):
    call = '{"tool_calls":[{"id":"b","name":"reply","arguments":{"turn":3,"prompt":"hi"},"depends":["a"]},{"id":"a","name":"reply","arguments":{"prompt":"é\\"","x":"1"}}]}'
    two = '{"tool_calls":[{"id":"c","name":"reply","arguments":{"turn":"7","prompt":5}},{"id":"3","name":"reply","arguments":"{\\"turn\\":1, \\"prompt\\":\\"p\\"}"},{"id":"d","name":"reply","arguments":[1]},{"name":"reply"},7]}'
    m = [
        (1, 0, "system", "s"), (1, 1, "user", "Hi\n"), (1, 2, "assistant", "Yo"), (1, 2, "assistant", "Yo"), (1, 3, "user", None),
        (2, 0, "assistant", call), (2, 0, "assistant", two), (2, 1, "tool", '{"tool_call_id":"a","content":"R"}'), (2, 1, "tool", '{"tool_call_id":"b","content":{"z":[1, {"y":2,"x":null}],"a":0.5}}'),
        (2, 3, "user", "three"), (2, 4, "assistant", "four"), (2, 4, "tool", '{"tool_call_id":"3","content":null}'),
        (None, 0, "user", "x"), (3, None, "user", "x"),
        (4, 0, "assistant", '{"tool_calls":[{"id":"p","name":"none","arguments":{},"depends":["q"]}]}'), (4, 1, "assistant", '{"tool_calls":[{"id":"q","name":"none","arguments":{"k":{"b":1,"a":{"d":1,"c":[true,null]}}},"depends":["p"]}]}'),
        (5, 0, "user", "x" * 401), (6, 0, "assistant", '{"tool_calls": broken'),
    ]
    d = spark.createDataFrame([(*r, 1) for r in m], "conv_id long, turn long, role string, text string, position int")
    rows = chat.link(d).collect()
    got = {(r["conv_id"], r["call_id"], r["kind"][0]): r for r in rows}
    assert got[1, "1", "i"]["record"] == '{"arguments":{"prompt":"Hi\\n","turn":1},"id":"1","name":"reply","result":"Yo"}'
    assert got[1, "1", "i"]["status"] == "linked" and got[1, "3", "i"]["status"] == "unanswered"
    assert got[2, "a", "s"]["problems"] == "missing:turn,unknown:x" and got[2, "a", "s"]["result_turn"] == 1
    assert got[2, "a", "s"]["position"] < got[2, "b", "s"]["position"]
    # both results of one turn are linked, nested values keep their types and come in order of their keys
    assert got[2, "b", "s"]["record"] == '{"arguments":{"prompt":"hi","turn":3},"id":"b","name":"reply","result":"{\\"a\\":0.5,\\"z\\":[1,{\\"x\\":null,\\"y\\":2}]}"}'
    assert got[2, "c", "s"]["problems"] == "type:prompt,type:turn" and got[2, "c", "s"]["record"].startswith('{"arguments":{"prompt":5,"turn":"7"}')
    # a stated id that looks like a turn
    assert got[2, "3", "s"]["status"] == "linked" and got[2, "3", "s"]["result_turn"] == 4 and got[2, "3", "i"]["record"].endswith('"result":"four"}')
    assert got[2, "d", "s"]["problems"] == "type:arguments"
    assert got[4, "p", "s"]["position"] is None and got[4, "q", "s"]["problems"] == "tool:none" and '{"k":{"a":{"c":[true,null],"d":1},"b":1}}' in got[4, "q", "s"]["record"]
    assert got[5, "0", "i"]["problems"] == "long:prompt" and len(got) == len(rows) == 11
    assert chat.link(spark.createDataFrame([], d.schema)).count() == 0


def brute_chat(table):
    """Linking written out over plain lists: {(conversation, kind, id): (turn, result turn, problems, record, level)}."""
    calls, results = {}, {}

    def put(into, k, v):
        into[k] = min(into.get(k, v), v, key=lambda x: (x[0], x[1] is not None, x[1] or ""))

    def canon(x):
        return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    for conv, turn, role, t in set(table):
        if conv is None or turn is None:
            continue
        t = t or ""
        try:
            j = json.loads(t) if t.lstrip(" ").startswith("{") else None
        except ValueError:
            j = None
        if role == "user":
            put(calls, (conv, "implied", str(turn)), (turn, t))
        if role == "assistant":
            put(results, (conv, "implied", str(turn - 1)), (turn, t))
            for c in (j or {}).get("tool_calls") or []:
                if c.get("id") is not None:
                    put(calls, (conv, "stated", c["id"]), (turn, canon(c)))
        if role == "tool" and j and j.get("tool_call_id") is not None:
            c = j.get("content")
            put(results, (conv, "stated", j["tool_call_id"]), (turn, c if c is None or isinstance(c, str) else canon(c)))
    out, needs = {}, {}
    for (conv, kind, i), (turn, x) in calls.items():
        c = {"name": "reply", "arguments": {"prompt": x, "turn": turn}} if kind == "implied" else json.loads(x)
        args = c.get("arguments", {})
        wrong = []
        if c.get("name") != "reply":
            wrong = [f"tool:{c.get('name') or ''}"]
        else:
            wrong += [f"unknown:{k}" for k in args if k not in ("prompt", "turn")] + [f"missing:{k}" for k in ("prompt", "turn") if k not in args]
            wrong += ["type:prompt"] * ("prompt" in args and not isinstance(args["prompt"], str)) + ["type:turn"] * ("turn" in args and type(args["turn"]) is not int)
            wrong += ["long:prompt"] * (isinstance(args.get("prompt"), str) and len(args["prompt"]) > 400)
        r = results.get((conv, kind, i), (None, None))
        out[conv, kind, i] = (turn, r[0], ",".join(sorted(wrong)), canon({"arguments": args, "id": i, "name": c.get("name"), "result": r[1]}))
        needs[conv, kind, i] = {(conv, kind, d) for d in c.get("depends") or [] if (conv, kind, d) in calls}
    return out, needs


def test_chat_against_brute_force(spark):
    """Random conversations with cycles, ids that clash with turns, forward and backward dependencies, nested and wrong arguments, repeated rows."""
    rng = random.Random(12)
    table = []
    for conv in range(40):
        ids = [rng.choice(["a", "b", "c", "d", "0", "1", "2", "5"]) for _ in range(rng.randrange(1, 9))]
        for turn in range(rng.randrange(1, 9)):
            kind = rng.choice(["user", "assistant", "calls", "tool", "tool", "calls"])
            if kind == "calls":
                made = []
                for _ in range(rng.randrange(1, 4)):
                    args = {"prompt": rng.choice(["p", 4, "é\n\"", "x" * 401, None]), "turn": rng.choice([1, "1", 1.5, [1], True]), "zz": {"b": [1, {"d": 0, "c": "ü"}], "a": None}}
                    made.append({"name": rng.choice(["reply", "reply", "other"]), "id": rng.choice(ids), "arguments": {k: args[k] for k in rng.sample(sorted(args), rng.randrange(4))}, "depends": rng.sample(ids, rng.randrange(min(3, len(ids) + 1)))})
                table.append((conv, turn, "assistant", json.dumps({"tool_calls": made}, ensure_ascii=False)))
            elif kind == "tool":
                table += [(conv, turn, "tool", json.dumps({"tool_call_id": rng.choice(ids), "content": rng.choice(["r", None, {"b": 1, "a": [2]}])})) for _ in range(2)]
            else:
                table.append((conv, turn, kind, rng.choice([None, "", "words\t", "{not json"])))
    table += table[:30] + [(None, 1, "user", "x"), (1, None, "user", "x"), (2, 3, None, "x")]
    want, needs = brute_chat(table)
    rows = chat.link(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    got = {(r["conv_id"], r["kind"], r["call_id"]): r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k]["turn"], got[k]["result_turn"], got[k]["problems"], got[k]["record"]) == w
    # positions: exactly the calls that reach no cycle have one, after all they need, and a conversation's run from 0
    free = set()
    while more := {k for k in needs if k not in free and needs[k] <= free}:
        free |= more
    assert {k for k, r in got.items() if r["position"] is not None} == free and len(free) < len(needs)
    assert all(got[d]["position"] < got[k]["position"] for k in free for d in needs[k])
    for conv in {k[0] for k in free}:
        at = sorted(r["position"] for k, r in got.items() if k[0] == conv and k in free)
        assert at == list(range(len(at)))


def test_chat_numbers_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    d = spark.createDataFrame([(1, 2 * i, "user", "x") for i in range(20)], "conv_id long, turn long, role string, text string")
    assert {r["turn"]: r["position"] for r in chat.link(d).collect()} == {2 * i: i for i in range(20)}


# ---------------------------------------------------------------- 5


def brute_near(pairs, size, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text(t).translate(lower))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(pairs)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        r = root(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(pairs)]


def key(r):
    return tuple(order(x) for x in r)


def test_near(docs, none):
    for size in (4, 5):
        got = near.near_groups(docs, size=size).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(key, got)) == sorted(map(key, brute_near([r[:2] for r in rows()], size)))
    assert near.near_groups(none).count() == 0
    kept = near.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 0


@pytest.mark.parametrize("rounds,block,elements", [(3, 1024, 1 << 20), (0, 4, 1 << 20), (1, 3, 1 << 20), (0, 1024, 300)])
def test_near_groups_below_the_threshold(spark, rounds, block, elements, monkeypatch):
    monkeypatch.setattr(near, "ELEMENTS", elements)
    """Many texts that are like each other, but mostly not enough: hub rounds and blocks must give the same links."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    pairs = []
    for i in range(70):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 2, 3, 4])):
            w[k] = f"m{i}_{k}"
        pairs.append((i, " ".join(w)))
    got = near.near_groups(spark.createDataFrame(pairs, "doc_id long, text string"), size=4, rounds=rounds, block=block)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute_near(pairs, 4))


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))])
    ra, rb, ru = near.registers([a, b, np.unique(np.concatenate([a, b]))], 1024)
    true = 2400 / (len(a) + len(b) - 2400)
    assert abs(near.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.06
    # registers of a union are the larger ones; draws beyond the reach of the smaller sets don't matter
    assert (near.merge(ra, rb) == ru).mean() > 0.99
    assert not near.registers([np.empty(0, np.uint64)], 16).any()


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint32)) for _ in range(40)]
    got = near.overlaps(sets[:25], sets[25:], dense=5)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    d = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["label"], "big") for r in components.components(Tables(spark), d, small=small).collect()}
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


def test_shingles_of_short_texts():
    import pyarrow as pa

    sets = shingle_sets(*utf8(pa.array(["", None, "A b", "a B", "a b c d", "a b c d e", " \t"])), 4)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 2, 0] and sets[2] == sets[3]


# ---------------------------------------------------------------- 6


def brute_lines(pairs, least=100, shortest=20):
    """Every later document against every earlier one that is the first with one of its lines."""
    uniq = {}
    for i, t in sorted({(order(i), text(t)) for i, t in pairs}):
        uniq[i, t] = t.split("\n") if t else []
    blank = lambda x: not x.strip(" \t\n\x0b\x0c\r")
    first = {}
    for k, ls in uniq.items():
        for x in ls:
            if not blank(x) and len(x.encode()) + 1 > shortest:
                first.setdefault(x, k)
    out = {}
    for k, ls in uniq.items():
        code = {}
        num = lambda x: 0 if blank(x) else code.setdefault(x, len(code) + 1)  # noqa: B023, E731
        own = [num(x) for x in ls]
        gone = [False] * len(ls)
        for p in {first[x] for x in ls if x in first} - {k}:
            for a, b in lines.blocks(own, [len(x.encode()) + 1 for x in ls], [num(x) for x in uniq[p]], least):
                gone[a:b] = [True] * (b - a)
        left = [x for x, g in zip(ls, gone, strict=True) if not g]
        out[k] = (len(left), sum(gone), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_line_dedup(docs, none):
    own = docs.where("doc_id is not null or text like 'lost%'")
    given = [(i, t) for i, t, *_ in rows() if i is not None or text(t).startswith("lost")]
    want = brute_lines(given)
    got = sorted((order(r["doc_id"]), r["n_kept"], r["n_removed"], r["kept_sha256"]) for r in lines.digests(own).collect())
    assert got == sorted((order(i), *want[order(i), text(t)]) for i, t in given)
    assert sum(x[2] for x in got) > 12
    assert lines.digests(none).count() == 0


def all_pairs_lines(pairs, least=100):
    """Every later document against every earlier one."""
    uniq, out, code = sorted({(order(i), text(t)) for i, t in pairs}), {}, {}
    cut = {k: k[1].split("\n") if k[1] else [] for k in uniq}
    num = {k: [0 if not x.strip(" \t\n\x0b\x0c\r") else code.setdefault(x, len(code) + 1) for x in ls] for k, ls in cut.items()}
    for n, k in enumerate(uniq):
        gone = [False] * len(cut[k])
        for e in uniq[:n]:
            for a, b in lines.blocks(num[k], [len(x.encode()) + 1 for x in cut[k]], num[e], least):
                gone[a:b] = [True] * (b - a)
        left = [x for x, g in zip(cut[k], gone, strict=True) if not g]
        out[k] = (len(left), sum(gone), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def same_as_all_pairs(spark, given):
    want = all_pairs_lines(given)
    got = lines.digests(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert sorted((order(r["doc_id"]), r["n_kept"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((order(i), *want[order(i), text(t)]) for i, t in given)
    return {r["doc_id"]: r["n_removed"] for r in got}


def test_line_dedup_tries_later_holders(spark):
    few = [f"shared line number {i} of the block" for i in range(5)]
    alone = [f"a line that only one document has {i}" for i in range(9)]
    p, q = "P" * 120, "Q" * 120
    given = [(1, "\n".join(x for pair in zip(few, alone, strict=False) for x in pair)), (2, "\n".join([alone[5], *few])), (3, "\n".join([*few, alone[6]]))]
    given += [(11, f"{p}\n{alone[7]}\n{q}"), (12, q), (13, f"{q}\n{alone[8]}\n{p}")]
    lost = same_as_all_pairs(spark, given)
    assert lost[2] == 0 and lost[3] == 5 and lost[12] == 1 and lost[13] == 2


def test_line_dedup_against_every_earlier_document(spark):
    rng = random.Random(8)
    some = ["", " ", "}", *[f"short {i}" for i in range(5)], *[f"a line of middling length, number {i}, and so on" for i in range(10)], *[c * 110 for c in "abcdef"]]
    runs = [[rng.choice(some) for _ in range(rng.randrange(2, 7))] for _ in range(8)]
    given = []
    for i in range(60):
        parts = [rng.choice(runs) if rng.random() < 0.7 else [rng.choice(some), f"own {i} {k}"] for k in range(rng.randrange(1, 7))]
        given.append((i if i % 20 else None, "\n".join(x for part in parts for x in part)))
    assert sum(same_as_all_pairs(spark, given).values()) > 100


def test_patience_is_an_alignment():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(25))]
        b = [rng.randrange(12) for _ in range(rng.randrange(25))]
        p = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))
    assert lines.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]


def test_line_dedup_of_short_lines(spark):
    verse = "\n".join(f"v{i} {{" for i in range(30))
    lost = same_as_all_pairs(spark, [(1, f"one\n{verse}\nend"), (2, f"two\n{verse}\nstop"), (3, "\n".join(verse.split("\n")[:10]))])
    assert lost == {1: 0, 2: 30, 3: 0}


def test_repeated_passages_are_aligned():
    """No line of PQRS is unique: one of the copies is aligned all the same; two where both sides have two."""
    one, two = [10, 1, 2, 3, 4, 11], [20, 1, 2, 3, 4, 21, 1, 2, 3, 4, 22]
    for later, earlier in ((two, one), (one, two)):
        assert [b - a for a, b in lines.blocks(later, [30] * len(later), earlier, 100)] == [4]
        assert not lines.blocks(later, [20] * len(later), earlier, 100)
    other = [30, 31, 1, 2, 3, 4, 32, 0, 1, 2, 3, 4, 33]
    assert lines.blocks(two, [30] * len(two), other, 100) == [(1, 5), (6, 10)]
    # a long gap of repeated lines
    a, b = ([x for i in range(20_000) for x in (1, k + i)] for k in (100, 50_000))
    assert len(lines.blocks([7, *a], [120] * (len(a) + 1), [8, *b], 100)) == 20_000


def test_heaviest_block():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(1, 6) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        w = [rng.randrange(1, 9) for _ in a]
        want = max((sum(w[i : i + n]) for i in range(len(a)) for n in range(1, len(a) - i + 1) if any(b[j : j + n] == a[i : i + n] for j in range(len(b)))), default=0)
        got = lines.heaviest(a, b, w, 1)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got) and (sum(w[got[0][0] : got[0][0] + got[0][2]]) if got else 0) == want
        assert not lines.heaviest(a, b, w, want + 1)


# ---------------------------------------------------------------- 7


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark, docs, none):
    got = mixing.plan(docs).collect()
    sizes = {}
    for _, t, _, s, *_ in rows():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text(t)))
    want = brute_targets(sizes)
    by_target = {round(r["target"], 6): r["source_size"] for r in got}
    assert by_target == {round(want[s], 6): sizes[s] for s in sizes}
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.plan(none).count() == 0
    m = mixing.mixed(docs)
    assert m.columns == docs.columns and m.count() == sum(r["copies"] for r in got)


def test_mixing_water_level(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 50, 500, 3000]) for i in range(9)}
        d = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
        got = {r["_mx_source"]: r["_mx_target"] for r in mixing.targets(d).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def strays(plan, sources):
    """taken / target by source."""
    joined = plan.join(sources, "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    return {r["source"]: r["sum(taken)"] / r["max(target)"] for r in joined if r["max(target)"]}


def test_mixing_comes_near_its_targets(spark, sf):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(5, 60)), f"s{i % 4}") for i in range(8000)], "doc_id long, text string, source string")
    assert all(abs(x - 1) < 0.02 for x in strays(mixing.plan(d), d.select("doc_id", "source")).values())
    # a source of few and very unequal documents: one holds a fifth of its words
    d = spark.createDataFrame([(i, " ".join(["w"] * (400 if i < 3 else rng.randrange(5, 60))), f"s{i % 3}") for i in range(150)], "doc_id long, text string, source string")
    for seed in range(4):
        assert all(abs(x - 1) < 0.05 for x in strays(mixing.plan(d, seed=seed), d.select("doc_id", "source")).values())
    d = spark.read.parquet(f"{os.path.dirname(sf.rstrip('/'))}/sf0.01/documents.parquet")
    assert all(abs(x - 1) < 0.05 for x in strays(mixing.plan(d), d.select("doc_id", "source")).values())


def _brute_copies(docs, seed, source, rate, unit):
    total, share, out = sum(n for _, n in docs), rate - int(rate), {}
    words = taken = 0.0
    level = lambda n: next((k for k in range(6) if n * 4 ** (k + 1) > total), 6)
    for k in range(7):
        own = sorted((unit(f"{seed}:{i}"), i, n) for i, n in docs if n and level(n) == k)
        w = float(sum(n for *_, n in own))
        if not w:
            continue
        words += w
        f = min(max((share * words - taken) / w, 0.0), 1.0)
        u, c = unit(f"{seed}:{k}:{source}") * 2.0**-48, 0.0
        for h, i, n in own:
            past = c - u * w
            extra = (past + w if past < 0 else past) < f * w if k < 6 else h * 2.0**-48 < f
            out[i] = int(rate) + extra
            taken += n * extra if k < 6 else 0
            c += n
    return out


def test_mixing_draws(spark):
    """Against the draws written out, and over many seeds each document's probability is its source's fraction."""
    rng = random.Random(5)
    own = {s: [(100 * k + i, rng.choice([1, 3, 10, 200]) + 40_000 * (k == 1 and i > 30)) for i in range(1 + 39 * (k < 3))] for k, s in enumerate(["a", "b", "c", "d"])}
    given = [(i, " ".join(["w"] * n), s) for s, docs in own.items() for i, n in docs]
    d = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["copies"] for r in mixing.plan(d, seed=3).collect()}
    rates = {r["_mx_source"]: r["_mx_rate"] for r in mixing.targets(d).collect()}
    for s, docs in own.items():
        want = _brute_copies(docs, 3, s, rates[s], lambda name: int(hashlib.md5(name.encode()).hexdigest()[:12], 16))
        assert {i: got[i] for i, _ in docs} == want
    docs, seen = [(i, 1 + i % 7 + 60 * (i == 3)) for i in range(60)], np.zeros(60)
    for seed in range(4000):
        for i, n in _brute_copies(docs, seed, "s", 0.3, lambda name: int(hashlib.md5(name.encode()).hexdigest()[:12], 16)).items():
            seen[i] += n
    assert abs(seen / 4000 - 0.3).max() < 0.035


# ---------------------------------------------------------------- 8


def pad(t):
    raw = t.encode()
    return raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")


def test_media_structure():
    """Segments between scans are read by their lengths, frames by their check sums; a wrong byte in either is found."""

    def crc(data, bits, poly):
        r = 0
        for x in data:
            r ^= x << (bits - 8)
            for _ in range(8):
                r = (r << 1 ^ poly if r >> (bits - 1) & 1 else r << 1) & ((1 << bits) - 1)
        return r

    def frame(n, body):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, n])
        head += bytes([crc(head, 8, 0x07)])
        return head + body + crc(head + body, 16, 0x8005).to_bytes(2, "big")

    stream = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(4) + (20).to_bytes(3, "big") + bytes(27)
    flac = stream + frame(0, bytes(range(40))) + frame(1, bytes(range(60, 90)))
    assert media.flac(flac, 0) == len(flac) and (4, len(flac), "audio/flac") in media.media_in(b"junk" + flac + b"tail")
    for k in (len(stream) + 4, len(stream) + 20, len(flac) - 1):
        assert media.flac(flac[:k] + bytes([flac[k] ^ 1]) + flac[k + 1 :], 0) != len(flac)
    scan = b"\xff\xda\0\x04cd\1\xff\0\xff\xd0\2"
    jpg = b"\xff\xd8\xff\xe0\0\x06\xff\xd9ab" + scan + b"\xff\xc4\0\x04\xff\xd9" + scan + b"\xff\xd9"
    assert media.jpeg(jpg, 0) == len(jpg) and media.jpeg(jpg[:-2], 0) == 0 and media.jpeg(jpg.replace(b"\xff\xc4\0\x04", b"\xff\xc4\0\x01"), 0) == 0
    many = b"%PDF-1.4 PK\x03\x04" * 60_000
    start = time.time()
    assert media.media_in(many) == [] and time.time() - start < 20


def test_media(docs, none):
    got = sorted((order(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.examined(media.stored(docs)).collect())
    want = []
    for i, t, *_ in rows():
        raw = text(t).encode()
        n = max(192, -(-len(raw) // 192) * 192)
        p = raw.ljust(n, b" ")
        want.append((order(i), len(raw), n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want)
    # the stored form's bytes, and the features, made again without the operator
    for r in media.examined(media.stored(docs)).collect():
        t = next(text(t) for i, t, *_ in rows() if i == r["doc_id"] and hashlib.sha256(pad(text(t))).hexdigest() == r["payload_sha256"])
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(media.RATE)
            w.writeframes(pad(t))
        plain = out.getvalue()
        own = b"olen" + struct.pack("<IQ", 8, len(t.encode()))
        whole = b"RIFF" + struct.pack("<I", len(plain) - 8 + len(own)) + plain[8:36] + own + plain[36:]
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
        x = [c - 128 for c in pad(t)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        parts = r["feature"].split(";")
        assert parts[:4] == ["audio/wav", f"rate={media.RATE}", "bits=8", f"frames={len(x)}"] and f"crossings={crossings}" in parts
        assert abs(float(parts[4].split("=")[1]) - sum(x) / len(x)) < 1e-3 and abs(float(parts[5].split("=")[1]) - (sum(c * c for c in x) / len(x)) ** 0.5) < 1e-3
    assert media.examined(media.stored(none)).count() == 0
    one = media.examined(media.stored(docs)).where("doc_id = 2").first()
    assert one["media_type"] == "audio/wav" and one["corrected"] and one["valid"]


def test_media_formats(spark):
    import gzip
    import io
    import zipfile

    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b" * 50)
    bmp = b"BM" + (58).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + b"\1\0\0\0\1\0\0\0\1\0\x18\0" + b"\0" * 24 + b"\1\2\3\0"
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd\1\2\xff\0\3\xff\xd9"
    pdf = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    flat = {"image/png": png, "image/gif": gif, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"hello" * 9), "image/bmp": bmp, "image/jpeg": jpg, "application/pdf": pdf, "audio/wav": media.wave(b"a" * 192, 5)}
    for kind, v in flat.items():
        assert media.media_in(v)[0] == (0, len(v), kind), kind
        assert (7, len(v), kind) in media.media_in(b"garbage" + v + b"end"), kind
        assert not [m for m in media.media_in(v[:-1]) if m[0] == 0 and m[2] == kind], kind
    d = spark.createDataFrame([(1, "text/plain", png), (2, "image/gif", gif[:-1]), (3, None, None), (4, "x/y", b"")], "doc_id long, declared string, media binary")
    got = {r["doc_id"]: r for r in media.examined(d).collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["corrected"]
    assert got[2]["media_type"] == "image/gif" and not got[2]["valid"]
    assert got[3]["media_type"] is None and got[4]["media_bytes"] == 0
    inner = media.examined(spark.createDataFrame([(1, "a", media.wave(b"xx" + png, 9))], d.schema)).first()
    assert [(c["kind"], c["length"]) for c in inner["carved"]] == [("image/png", len(png))]


# ---------------------------------------------------------------- 9


def test_exact(docs, none):
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text(t)), []).append((-len(text(t)), order(i), i))
    want = []
    for i, t, *_ in rows():
        n = re.sub(r"[\x20\x09-\x0D]", "", text(t))
        keep = min(groups[n])
        want.append((order(i), keep[1], len(groups[n]), order(i) == keep[1], hashlib.sha256(n.encode()).hexdigest()))
    got = sorted((order(r[0]), order(r[1]), *r[2:]) for r in exact.groups(docs).collect())
    assert got == sorted(want)
    left = exact.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.groups(none).count() == 0 and exact.deduplicate(none).count() == 0


@pytest.mark.parametrize("ordered", [True, False])
def test_trie(ordered):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)] + [b"", b"a" * 5000, b"a" * 5000 + b"b"]
    out = []
    trie = exact.PatriciaTrie(out.append, ordered)
    for t in sorted(texts) if ordered else texts:
        node = trie.insert(t)
        node.value = (t, (node.value or (t, 0))[1] + 1)
    trie.close()
    counts = {t: texts.count(t) for t in texts}
    assert dict(out) == counts and len(out) == len(counts)


def test_tries_decide(spark, sf):
    """In the query's own path one trie holds many strings: labels are split, subtrees spilled, and terminals give owners and sizes."""
    from collections import Counter

    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["a b", "ab", "abc", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    batches = exact._dealt(d, False).coalesce(1).sortWithinPartitions("_xd_norm").toArrow().combine_chunks().to_batches(max_chunksize=7)
    done = []
    trie = exact.PatriciaTrie(done.append)
    assert len(list(exact._inserted(batches, trie))) == sum(b.num_rows for b in batches)
    trie.close()
    sizes = Counter(exact._normal(t) for t in texts)
    assert trie.splits > 20 and trie.spilled > 100
    assert sorted(v[1] for v in done) == sorted(sizes.values())
    out = [r for b in exact._terminals(iter(batches)) for r in b.to_pylist()]
    owners = {r["terminal"]: r for r in out if r["members"] is None}
    assert len(owners) == len(sizes) and sorted(i for r in out for i in r["members"] or ()) == list(range(len(texts)))
    for r in out:
        for i in r["members"] or ():
            mine = owners[r["terminal"]]
            assert exact._normal(texts[i]) == exact._normal(texts[mine["keep_id"]]) and mine["group_size"] == sizes[exact._normal(texts[i])]


def test_hot_text_in_steps(spark, monkeypatch):
    monkeypatch.setattr(exact, "HELD_ROWS", 5)
    d = spark.createDataFrame([(i, "hot text " + "  " * (i == 17) if i % 3 else f"own {i}") for i in range(60)], "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r for r in exact.groups(d).collect()}
    assert len(got) == 60 and all(got[i]["keep_id"] == 17 and got[i]["group_size"] == 40 for i in range(60) if i % 3)
    assert all(got[i]["kept"] == (i == 17 or i % 3 == 0) for i in range(60))
    assert {r["doc_id"] for r in exact.deduplicate(d).collect()} == {17, *range(0, 60, 3)}


# ---------------------------------------------------------------- 10


def test_language(spark, sf, none):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(d).collect()
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none).count() == 0


def test_language_edges(docs, spark):
    f = langid.fit(docs)
    e = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "q"), (None, "日本")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(e, f).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] in f.languages and got[None]["lang_pred"] in f.languages
    kept = langid.reject(docs.withColumn("score", docs["doc_id"]))
    assert kept.columns == [*docs.columns, "score"] and kept.where("score <> doc_id").count() == 0 and kept.where("doc_id in (5, 6, 7)").count() == 0
    empty = langid.fit(docs.where("lang = 'none'"))
    assert langid.predict(e, empty).where("lang_pred <> 'und'").count() == 0


def test_language_sample(spark):
    """The rows of smallest hash, whatever share of the table a language has; rows that repeat count once."""
    rng = random.Random(4)
    d = spark.createDataFrame([(i % 3000, rng.choice(["a"] * 30 + ["b"] * 3 + ["c"])) for i in range(4000)], "doc_id long, lang string")
    got = {tuple(r) for r in langid.sampled(d, 40).collect()}
    hashed = {}
    for r in d.selectExpr("doc_id", "lang", "xxhash64(doc_id) h").distinct().collect():
        hashed.setdefault(r["lang"], []).append((r["h"], r["doc_id"]))
    assert got == {(i, lang) for lang, hs in hashed.items() for _, i in sorted(hs)[:40]}


def brute_language(labelled, texts, least=2, purity=0.1):
    """Exact sets of n-grams in place of filters, character by character."""

    def grams(t):
        b = [32, *(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in t.encode()), 32]
        return [tuple(b[i : i + 4]) for i in range(len(b) - 3) if b[i + 1] != 32 and b[i + 2] != 32]

    count, sizes = {}, {}
    for lang, t in labelled:
        sizes[lang] = sizes.get(lang, 0) + 1
        for g in set(grams(t)):
            by = count.setdefault(g, {})
            by[lang] = by.get(lang, 0) + 1
    known = {lang: set() for lang in sizes}
    for g, by in count.items():
        top = max(n / sizes[lang] for lang, n in by.items())
        for lang, n in by.items():
            if n >= least and n / sizes[lang] >= purity * top:
                known[lang].add(g)
    names, out = sorted(sizes), []
    common = max(names, key=lambda x: sizes[x]) if names else None
    for t in texts:
        if not names or not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        gs = grams(t)
        share = [sum(g in known[x] for g in gs) / max(1, len(gs)) for x in names]
        best = max(range(len(names)), key=lambda i: (share[i], -i))
        out.append((names[best], share[best]) if share[best] else (common, 0.0))
    return out


def test_language_against_exact_sets(spark, sf):
    """Same languages and scores as exact n-gram sets of the same rows; ties, repeated rows, nulls and short texts among them."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, "½ ²", None), (9002, "Ⅷ ① 42", None), (9003, "q", None), (9004, "", None), (9005, None, "en"), (9006, "日本", "en"), (9006, "日本", "en"), (None, "Das ist ein Text", "de"), (9007, "a" * 300_000, None)]
    d = d.union(spark.createDataFrame(odd, d.schema))
    given = d.collect()
    out_ = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    labelled = [(r["lang"], r["text"]) for r in given if r["lang"] and r["text"] is not None and r["doc_id"] is not None and not out_(r["doc_id"])]
    want = {}
    for r, (lang, score) in zip(given, brute_language(labelled, [r["text"] for r in given]), strict=True):
        want[r["doc_id"], r["text"]] = (lang, score)
    texts = {r["doc_id"]: r["text"] for r in given}
    got = langid.identify(d).collect()
    assert len(got) == len(given)
    for r in got:
        lang, score = want[r["doc_id"], texts[r["doc_id"]]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 0.01 and r["held_out"] == out_(r["doc_id"])


def test_language_filters_against_sets():
    """No n-gram that was put in is missed, and false positives stay near the corrected rate."""
    rng = np.random.default_rng(3)
    g = rng.integers(0, 2**32, 4000).astype(np.uint32)
    table = np.zeros((1 << 14, 1), np.uint64)
    for s in langid.slots(g, 14, 2):
        table[s] |= np.uint64(1)
    f = langid.Filters(["x"], 14, 2, table, np.array([0.0]), 0)
    assert (f.hits(g) & np.uint64(1)).all()
    fill = (table > 0).mean()
    other = (f.hits(rng.integers(0, 2**32, 20000).astype(np.uint32)) & np.uint64(1)).mean()
    assert abs(other - fill**2) < 0.02
