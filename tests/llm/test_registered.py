"""The registered queries of the corpus operators against brute force over the smallest test tables."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def rows_of(spark, name):
    df = QUERIES[name](spark, SF)
    return dict(df.dtypes), [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints_query(spark, texts):
    types, rows = rows_of(spark, "op2_fingerprints")
    assert types["n_chars"] == "bigint" and types["near_edited"] == types["near_next"] == "double"
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    down = sorted(texts, reverse=True)
    after = dict(zip(down, down[1:] + down[:1]))
    seen = {}
    for r in rows:
        own, half = texts[r["doc_id"]], len(texts[r["doc_id"]]) // 2
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == sha(own[: len(own) - half] + texts[after[r["doc_id"]]][:half])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert seen.setdefault(own, r["fingerprint"]) == r["fingerprint"]


def test_chat_query(spark):
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for conv, _, role, text in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        turns.setdefault(conv, []).append((role, text or ""))
    _, rows = rows_of(spark, "op3_chat")
    assert sorted(r["conv_id"] for r in rows) == sorted(turns)
    for r in rows:
        said = turns[r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(said), len(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in said))
        assert r["loss_sha256"] == sha(loss) and r["formatted_chars"] >= sum(len(t) for _, t in said)


def test_sharding_query(spark, texts):
    _, rows = rows_of(spark, "op5_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots, of_text, bytes_of = {}, {}, dict.fromkeys(range(40), 0)
    for r in rows:
        octets = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(octets) + 16, zlib.crc32(octets), "bytes", None)
        assert of_text.setdefault(octets, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        bytes_of[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in rows:
        groups[texts[r["doc_id"]]] = groups.get(texts[r["doc_id"]], 0) + r["size"]
    assert max(bytes_of.values()) <= sum(bytes_of.values()) / 40 + max(groups.values())


def test_media_query(spark, texts):
    _, rows = rows_of(spark, "op6_media")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    same = {}
    for r in rows:
        octets = texts[r["doc_id"]].encode()
        payload = octets + bytes(max(64, -(-len(octets) // 64) * 64) - len(octets))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(octets), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert same.setdefault(octets, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_token_query(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    _, rows = rows_of(spark, "op8_tokens")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_minhash_query(spark, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    spaces = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
    sets = {}
    for i, t in texts.items():
        words = [w for w in t.translate(lower).translate(spaces).split(" ") if w]
        sets[i] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    _, rows = rows_of(spark, "op9_minhash")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_pieces_query(spark, texts):
    _, rows = rows_of(spark, "op10_pieces")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["lossless"] and (r["n_pieces"] > 0) == bool(texts[r["doc_id"]].strip()) for r in rows)


@pytest.mark.parametrize(("name", "label", "least_of_ones", "least_of_zeros"), [("op1_quality", "quality", 0.9, 0.9), ("op7_toxicity", "toxic", 0.55, 0.97)])
def test_classifiers_on_held_out_labels_of_a_small_table(spark, name, label, least_of_ones, least_of_zeros):
    """Recall of both kinds through the registered query; the toxicity learner has 37 toxic texts here, so its invented words stay unknown."""
    sf = "/root/testdata/sf0.01"
    given = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in QUERIES[name](spark, sf).collect() if r.held_out and r.doc_id in given]
    recall = [sum(r.predicted == k for r in rows if given[r.doc_id] == k) / sum(given[r.doc_id] == k for r in rows) for k in (0, 1)]
    assert recall[1] >= least_of_ones and recall[0] >= least_of_zeros
