"""The conversation trie against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evidentia.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # Ties of a turn number go by the digest of the turn.
    return {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()[:16]))] for c, v in own.items()}


def rebuilt(own, group=5, most=9):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, group))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        rows[path] = (
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(rows.values(), key=repr)


def found(spark, rows, build):
    made = prefix_trie.prefix_trie(*build(spark.createDataFrame(rows, SCHEMA)))
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, made.collect()), key=repr)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for conv in range(-6, 40):
        depth = rng.choice([1, 2, 3, 5, 9, 14])
        for turn in range(depth):
            said = rng.choice("ab") if turn < 4 else "same" if conv % 3 else f"own {conv}"
            rows.append((conv, turn if turn % 5 else None, rng.choice(["user", "assistant"]) if turn < 2 else "user", said * (turn + 1)))
    hot = [(turn, "user" if turn % 2 == 0 else "assistant", f"line {turn} é") for turn in range(12)]
    rows += [(conv, *t) for conv in range(100, 160) for t in hot]
    rows += [(170, turn, "user", f"alone {turn}") for turn in range(300)] + [(conv, turn, "user", f"long {turn}") for conv in (180, 185, 190) for turn in range(120)]
    rows += [(None, 0, "user", "of nobody"), (200, None, None, None), (205, 1, "", "x"), (205, 1, "", "x"), (206, 2, "user", None), (207, 3, None, "ab"), (208, 3, "a", "b")]
    return rows


@pytest.mark.parametrize("build", [prefix_trie.as_they_are, prefix_trie.rebuilt])
def test_nodes(spark, build):
    rows = odd_rows()
    own = ordered(rows)
    assert found(spark, rows, build) == brute(own if build is prefix_trie.as_they_are else rebuilt(own))


def test_shards_share_their_spines(spark, monkeypatch):
    rng = random.Random(5)
    paths = sorted({tuple(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(150)} | {()})
    convs = {k: [("user", x) for x in p] for k, p in enumerate(paths)}
    digest = {x: hashlib.sha256(f"4:user{x}".encode()).digest()[:16] for x in "ab"}
    items = sorted((b"".join(digest[x] for x in p), k, p) for k, p in enumerate(paths))
    wanted = brute(convs)
    for size in (1, 2, 7, len(items)):
        frames = []
        for begin in range(0, len(items), size):
            part = items[begin : begin + size]
            ends = [hashlib.sha256(str(k).encode()).hexdigest() for _, k, _ in part]
            ones = np.ones(len(part), np.int64)
            frames.append(prefix_trie.shard_nodes(begin, [x[0] for x in part], [np.array([1] * len(x[2]), np.int64) for x in part], ones, np.array([x[1] for x in part]), ones * 0, ends))
        import pandas as pd

        whole = pd.concat(frames)
        merged = prefix_trie.merged_spines(whole[whole["name"].notna()])
        smallest = dict(zip(merged["name"], merged["conv_id"]))
        none = hashlib.sha256(b"").hexdigest()
        got = [(r.conv_id, r.depth, None if r.top else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or none) for r in merged.itertuples()]
        for r in whole[whole["name"].isna()].itertuples():
            got.append((r.conv_id, r.depth, smallest.get(r.above, r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or none))
        assert sorted(got, key=repr) == wanted


def test_findclose_over_many_blocks():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 60)
    shared = np.array([-1, *[rng.integers(0, min(a, b)) for a, b in zip(lengths, lengths[1:])]])
    trie = prefix_trie.Parentheses(lengths, shared)
    stack, closing = [], {}
    for k, opening in enumerate(trie.opening):
        if opening:
            stack.append(k)
        else:
            closing[stack.pop()] = k
    assert not stack and [closing[k] for k in trie.at] == trie.findclose(trie.at).tolist()


def test_no_conversations(spark):
    assert found(spark, [], prefix_trie.rebuilt) == [] == found(spark, [(None, 0, "user", "x")], prefix_trie.as_they_are)


def test_further_columns_do_not_matter(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", 5, "y"), (2, 0, "user", "x", 6, "z")], SCHEMA + ", depth int, span string")
    assert prefix_trie.prefix_trie(*prefix_trie.as_they_are(rows)).count() == 2
