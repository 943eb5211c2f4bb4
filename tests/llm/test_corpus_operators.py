"""The corpus operators on odd rows, against brute force, and by exact round trips."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import chat, fingerprints, media, mixing, neardup, pieces, quality, sharding, tokens, toxicity
from evidentia.llm._common import SpanHash
from evidentia.llm.labelled import crc_of_id

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept int, shard int, range int, class string, _before int, n_bytes string"
EXTRA = ("s", "x", 1, 2, 3, "c", 4, "b")
LONG = "lorem ipsum dolor " * 60_000
TEXTS = [
    (1, "een twee drie vier vijf zes zeven acht negen tien elf twaalf", "nl", "a", 60),
    (2, "een twee drie vier vijf zes zeven acht negen tien elf twaalf", "nl", "b", 60),
    (2, "een twee drie vier vijf zes zeven acht negen tien elf twaalf", "nl", "b", 60),
    (3, "een twee drie vier vijf zes zeven acht negen tien elf dertien", None, "b", 60),
    (4, None, None, None, None), (5, "", "en", "c", 0), (6, " \t\n ", "en", "c", 4), (7, "kort", "en", "a", 4), (8, LONG, "en", "a", len(LONG)),
    (None, "zonder nummer maar met woorden", "nl", "a", 30), (9, "日本語 é ﬁ 😀 <|endoftext|> ▁ \u0000", "ja", "b", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*t, *EXTRA) for t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


ALL_IDS = sorted((t[0] for t in TEXTS), key=str)


# --- mixing


def brute_mix(rows, weights=(1, 2, 3)):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in order if x not in capped)) for s in order if s not in capped}
        over = {s for s in share if share[s] >= 3 * sizes[s]}
        if not over:
            return sizes, {s: float(3 * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def test_mixing(spark, odd, none, docs):
    for frame in (odd, docs):
        found = mixing.mix_sources(frame).collect()
        plain = frame.collect()
        sizes, targets = brute_mix([(r.doc_id, r.text, r.source) for r in plain])
        assert ids(found) == ids(plain)
        taken = collections.Counter()
        for r in found:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
        assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(frame).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix_sources(docs).collect())
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix_sources(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_mixing_is_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- sharding


def check_shards(rows, shards):
    of_text, slots, load = {}, collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert of_text.setdefault(r.text_crc32, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)
    return load


def test_sharding(odd, none, docs):
    rows = sharding.pack_shards(docs, shards=6).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    load = check_shards(rows, 6)
    assert len(load) == 6 and max(load.values()) <= 1.05 * sum(load.values()) / 6
    found = sharding.pack_shards(odd, shards=4).collect()
    assert ids(found) == ALL_IDS
    check_shards(found, 4)
    assert sharding.pack_shards(none).collect() == []


def test_crowded_size_classes_are_numbered_in_parts(spark, docs, monkeypatch):
    same = spark.range(500).select("id", F.concat(F.lit("word "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text")).withColumnRenamed("id", "doc_id")
    both = docs.select("doc_id", "text").union(same)
    whole = sorted(sharding.pack_shards(both, shards=7).collect())
    load = check_shards(whole, 7)
    assert len(whole) == both.count() and max(load.values()) <= 1.05 * sum(load.values()) / 7
    monkeypatch.setattr(sharding, "CROWD", 20)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    parts = sharding.pack_shards(both, shards=7).collect()
    assert len(parts) == len(whole) and check_shards(parts, 7) == load


def test_packing_of_size_classes():
    random.seed(8)
    for _ in range(30):
        classes = {random.randint(1, 900): random.randint(1, 30) for _ in range(random.randint(1, 40))}
        runs = sharding.pack(list(classes.items()), 5)
        number, load = collections.Counter(), collections.Counter()
        for size, count, shard in runs:
            number[size] += count
            load[shard] += size * count
        total, largest = sum(s * n for s, n in classes.items()), max(classes)
        assert number == classes and set(load) <= set(range(5))
        assert max(load.values()) <= max(largest, 1.02 * (total / 5) + largest)
    assert sharding.pack([], 5) == []
    assert [c for _, _, c in sharding.pack([(1000, 2), (1, 30)], 4)][:2] == [0, 1]


def test_best_fit_decreasing():
    random.seed(3)
    for _ in range(30):
        items = [(random.randint(1, 50), k) for k in range(random.randint(0, 60))]
        bins = sharding.best_fit_decreasing(items, 50)
        size = dict((k, s) for s, k in items)
        assert sorted(k for b in bins for k in b) == sorted(size) and all(sum(size[k] for k in b) <= 50 for b in bins)
        left, plain = [], 0
        for s, _ in sorted(items, reverse=True):
            fits = [c for c in left if c >= s]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - s)
            else:
                left.append(50 - s)
                plain += 1
        assert len(bins) == plain


# --- near-duplicates


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, words, percent):
    found = neardup.near_duplicates(docs, words, percent).collect()
    wanted = brute_components([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted and all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("need", [None, 1])
def test_near_copies_around_one_text(spark, need):
    random.seed(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 160):
        w = list(base)
        for at in random.sample(range(150), random.randint(1, 7)):
            w[at] = f"x{random.randint(0, 60)}"
        rows.append((k, " ".join(w)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, need).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 85)


def test_rows_of_one_id_with_different_texts_are_judged_apart(spark):
    one, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (5, one), (5, other), (5, other.upper()), (7, other + " x"), (None, one), (None, one), (None, other)]
    left = neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in left) == [("1", one), ("5", other), ("None", one), ("None", other)]


def test_near_duplicates_of_odd_rows(odd, none):
    found = neardup.near_duplicates(odd, 3, 80).collect()
    assert ids(found) == ALL_IDS
    of = {r.doc_id: r for r in found}
    assert [of[k].component_id for k in (1, 2, 3)] == [1, 1, 1] and [of[k].component_id for k in (4, 5, 6, 7, 8, 9)] == [4, 5, 6, 7, 8, 9]
    assert of[4].n_shingles == 0 and of[7].n_shingles == 1 and of[8].n_shingles == 3 and of[None].component_id is None and of[None].kept
    left = neardup.without_near_duplicates(odd, 3, 80)
    assert left.columns == odd.columns and ids(left.collect()) == sorted([1, 4, 5, 6, 7, 8, 9, None], key=str)
    assert neardup.near_duplicates(none).collect() == [] and neardup.without_near_duplicates(none).collect() == []


# --- classifiers


def test_quality(odd, none, docs, labels):
    held_out = crc_of_id() % 5 == 0
    scored = quality.quality(docs, labels, ~held_out).join(labels, "doc_id").filter(held_out).collect()
    right = sum((r.score >= 0.3) == bool(r.quality) for r in scored)
    assert right >= 0.85 * len(scored)
    found = quality.quality(odd, labels, ~held_out).collect()
    assert ids(found) == ALL_IDS and all(0 <= r.score <= 1 for r in found)
    assert quality.quality(none, labels, ~held_out).collect() == []
    assert quality.of_quality(odd, labels, ~held_out).columns == odd.columns
    assert {r.score for r in quality.quality(odd, labels.limit(0), ~held_out).collect()} == {0.5}


def test_toxicity(odd, none, docs, labels):
    held_out = crc_of_id() % 4 == 2
    scored = toxicity.toxicity(docs, labels, ~held_out).join(labels, "doc_id").filter(held_out).collect()
    assert sum((r.score >= 0.3) == bool(r.toxic) for r in scored) >= 0.85 * len(scored)
    found = toxicity.toxicity(odd, labels, ~held_out).collect()
    assert ids(found) == ALL_IDS and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(none, labels, ~held_out).collect() == []
    assert toxicity.without_toxic(odd, labels, ~held_out).columns == odd.columns


def test_lexicon_sees_through_disguises():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0}, coefficients=(-3.0, 2.0, 0.1))
    automaton = lexicon.automaton()
    clean = lexicon.score("een heel gewone tekst", automaton)
    for text in ("you IDIOT", "1d10t!", "іdiоt", "ｉｄｉｏｔ", "id​iot"):
        assert lexicon.score(text, automaton) > clean
    for text in ("a trash can", "the Trash Can", "semidiot"):
        assert lexicon.score(text, automaton) == clean
    assert lexicon.score("trash", automaton) > lexicon.score("trash " + "woord " * 500, automaton) > clean


# --- fingerprints


def test_fingerprints(odd, none, docs):
    found = {r.doc_id: r for r in fingerprints.fingerprints(docs, rows_per_range=20).collect()}
    order = sorted(docs.collect(), key=lambda r: -r.doc_id)
    span_hash, of_text = SpanHash(), {}
    for r, after in zip(order, order[1:] + order[:1]):
        edited = fingerprints.edited_text(r.text, after.text)
        f = found[r.doc_id]
        assert f.n_chars == len(r.text) and f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert f.edited_fingerprint == fingerprints.fingerprint(*fingerprints.phrase_sets([edited], span_hash)[0])
        assert of_text.setdefault(r.text, f.fingerprint) == f.fingerprint
        assert f.near_next == fingerprints.likeness(f.fingerprint, found[after.doc_id].fingerprint)
    assert len(set(of_text.values())) == len(of_text)
    assert np.median([f.near_edited for f in found.values()]) > 0.4 > 0.2 > np.median([f.near_next for f in found.values()])
    rows = fingerprints.fingerprints(odd).collect()
    assert ids(rows) == ALL_IDS and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert fingerprints.fingerprints(none).collect() == []


def test_one_document(spark):
    r = fingerprints.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_phrases_do_not_depend_on_place():
    span_hash, draw = SpanHash(), random.Random(2)
    random_text = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    (_, a), (_, b) = fingerprints.phrase_sets([random_text, "voorvoegsel " + random_text], span_hash)
    assert len(set(a.tolist()) & set(b.tolist())) > 0.95 * len(a)


# --- chat


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "␛A <s> ␛"), (1, 2, "assistant", "␛A <s> ␛"), (2, None, None, None), (2, 5, "assistant", ""), (None, 1, "user", "x")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"tekst {k} [INST]") for k in range(300)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, span string")
    formatted = chat.formatted_turns(frame)
    assert not formatted.filter("rewrites").count()
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        f = found[conv]
        assert (f.n_turns, f.turns_sha256, f.loss_chars, f.loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert f.formatted_chars == len(chat.inst_template([(r, x) for _, _, r, x in own]))
    assert chat.read_back(chat.formatted_turns(frame.limit(0))).collect() == []


def test_chat_finds_templates_that_rewrite(spark):
    def forgetful(turns):
        return "".join(f"[{r}]{'…' if r == 'assistant' and k < len(turns) - 1 else x}" for k, (r, x) in enumerate(turns))

    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "lang antwoord"), (1, 2, "user", "b")], "conv_id long, turn long, role string, text string")
    assert [r.rewrites for r in chat.formatted_turns(frame, forgetful).orderBy("turn_no").collect()] == [False, False, True]


@pytest.mark.parametrize("template", [
    chat.inst_template, lambda turns: "".join(f"[{r}][INST]{x.strip()}[/INST]" for r, x in turns), lambda turns: f"{len(turns)}:" + "".join(f"{r}[{x}]" for r, x in turns),
    lambda turns: "|".join(f"[{r}[{x}]" for r, x in reversed(turns)),
])
def test_chat_masks_texts_like_their_marks(spark, template):
    texts = ["[abc]", "[abc", "[/", "[", "]", "[/INST", "[/[[", "[1] bron", "abc]", "", "a", "b", "ab", "ba", "</", "assistant[", "[assistant["]
    rows = [(k, 0, "user", "[a]") for k in range(len(texts))] + [(k, 1, "assistant", x) for k, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.formatted_turns(frame, template).filter("turn_no = 1").collect()}
    for k, x in enumerate(texts):
        r, whole = found[k], template([("user", "[a]"), ("assistant", x)])
        begin = r.loss_start + len(whole) - len(r.span)
        # A span may begin within the text if the template rewrites; the mask then has the rest of it.
        assert x.endswith(r.span[r.loss_start : r.loss_end]) and (r.rewrites or r.span[r.loss_start : r.loss_end] == x)
        assert whole[: begin] + x[len(x) - (r.loss_end - r.loss_start) :] + r.span[r.loss_end :] == whole


def test_chat_renders_the_whole_prefix(spark):
    def late(turns):
        """Rewrites turn 0 from turn 200 on, and numbers the turns."""
        return "".join(f"<{k}>{'…' if k == 0 and len(turns) > 200 else x}" for k, (_, x) in enumerate(turns))

    rows = [(1, k, "assistant" if k % 2 else "user", f"tekst {k}") for k in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.formatted_turns(frame, late).orderBy("turn_no").collect()
    assert [r.turn_no for r in found if r.rewrites] == [200]
    assert all(r.span == f"<{k}>tekst {k}" for k, r in enumerate(found) if not r.rewrites)
    assert found[200].span == late([(r, x) for _, _, r, x in rows[:201]])[len("<0>") :]
    with pytest.raises(ValueError):
        chat.formatted_turns(frame, late, history=64)
    bounded = chat.formatted_turns(frame, history=64).orderBy("turn_no").collect()
    assert bounded == chat.formatted_turns(frame).orderBy("turn_no").collect()
    with pytest.raises(Exception, match="declared local to a turn and is not"):
        chat.formatted_turns(frame, chat.local_to_a_turn(late), history=64).collect()


# --- media


def test_media(odd, none):
    found = media.media_features(media.media_column(odd))
    rows = found.collect()
    assert ids(rows) == ALL_IDS
    of = {t[0]: (t[1] or "").encode() for t in TEXTS}
    for r in rows:
        raw = of[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.errors) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), 0)
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes % 188 == 0
        assert r.timestamps == [k * media.UNIT_TICKS for k in range(-(-len(padded) // media.UNIT))] and r.access_points == list(range(0, len(r.timestamps), 4))
    assert media.media_features(media.media_column(none)).collect() == []


def test_transport_stream():
    payload = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8)
    stream = media.mux(payload)
    assert media.demux(stream).payload == payload.tobytes()
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    assert {p[0] for p in packets} == {0x47}
    assert media.demux(b"".join(packets[:20] + packets[21:])).errors > 0
    assert media.demux(b"x").errors == 1 and media.demux(b"").payload == b""
    assert media.section_checksum(b"123456789") == 0x0376E6E7


# --- tokens and pieces


def test_token_counts(odd, none, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for frame in (odd, docs):
        rows = tokens.prefix_ledgers(frame, path).collect()
        texts = frame.select("doc_id", "text").collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == sorted((str(t.doc_id), len((t.text or "").encode()), count(t.text or "")) for t in texts)
    assert tokens.prefix_ledgers(none, path).collect() == []
    asked = tokens.prefix_ledgers(docs.filter("n_chars > 100").limit(5), path).join(docs, "doc_id")
    for r in asked.select("text", tokens.tokens_of_prefix(F.col("ledger"), F.lit(50)).alias("n"), tokens.longest_prefix(F.col("ledger"), 20).alias("chars")).collect():
        assert r.n == count(r.text[:50]) and count(r.text[: r.chars]) <= 20 < count(r.text[: r.chars + 1])


def test_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), tokens.PrefixCounter(path)
    draw = random.Random(4)
    parts = ["a", "the", "'s", "'re", "'ll", " ", "  ", "\n", "!", "12", "é", "日本", "<|endoftext|>", "<|", "----", " The"]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))
        counts = np.cumsum(np.frombuffer(counter.ledger(text), np.int8), dtype=int).tolist()
        assert counts == [len(library.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]


def test_pieces(odd, none, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = pieces.encoded(docs, path, dropout=0.0).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.lossless and list(r.ids) == library.encode(r.text) for r in plain)
    varied = {seed: {r.doc_id: tuple(r.ids) for r in pieces.encoded(docs, path, 0.1, seed).filter("lossless").collect()} for seed in (1, 2)}
    assert varied[1].keys() == varied[2].keys() == {r.doc_id for r in plain}
    assert sum(varied[1][k] != varied[2][k] for k in varied[1]) > 0.8 * len(plain)
    assert varied[1] == {r.doc_id: tuple(r.ids) for r in pieces.encoded(docs, path, 0.1, 1).collect()}
    rows = pieces.encoded(odd, path).collect()
    assert ids(rows) == ALL_IDS and all(r.lossless for r in rows)
    assert pieces.encoded(none, path).collect() == []


def scanned(coder, unit, key):
    """Merge-dropout by its definition: look at all neighbours for the best union again after every step. Also the number of merges passed over."""
    symbols, over = [(k, c) for k, c in enumerate(unit)], set()
    while True:
        can = [(coder.order[a + b], k) for k, ((_, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in coder.order and (symbols[k], symbols[k + 1]) not in over]
        if not can:
            break
        k = min(can)[1]
        (i, a), (j, b) = symbols[k : k + 2]
        if key is not None and coder._dropped(key, coder._merge_place(i, len(a + b), j)):
            over.add(((i, a), (j, b)))
        else:
            symbols[k : k + 2] = [(i, a + b)]
    return [i for _, s in symbols for i in ([coder.ids[s]] if s in coder.ids else coder._in_bytes(s))], len(over)


def test_piece_dropout_against_a_plain_scan():
    """Every occurrence is merged by its own key, on both sides of the longest shared array, whether trees are kept or forgotten."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder = pieces.PieceModel(path, 0.1, 1)
    random.seed(3)
    letters = "etaoinshrdlu éßж日😀1"
    units = ["".join(random.choices(letters.replace(" ", ""), k=n)) for n in (1, 2, 3, 5, 7, 9, 11, 15, 20, 30, 40, 60, 62, 63, 64, 65, 70) for _ in range(8)]
    units += ["international", "internationalisation", "the", "verantwoordelijkheid"] * 50
    text = "  ".join([" ".join(units), "▁ x"])
    own = coder._units(text)
    keys = coder._keys(text, len(own)).tolist()
    wanted = [scanned(coder, pieces.MARK + u, k) for u, k in zip(own, keys)]
    assert coder.encode(text).tolist() == [i for ids, _ in wanted for i in ids]
    assert coder.encode(text).tolist() == [i for ids, _ in wanted for i in ids] and coder.decode(coder.encode(text)) == text
    assert any(n > 1 for _, n in wanted) and len({tuple(ids) for (ids, _), u in zip(wanted, own) if u == "internationalisation"}) > 8
    whole = coder.merge_many([pieces.MARK + u for u in own], np.array(keys, np.uint32))
    alone = [coder._merge(pieces.MARK + u, k) for u, k in zip(own, keys)]
    for field in ("ids", "n_ids", "places", "passed", "n_steps"):
        assert getattr(whole, field).tolist() == [x for one in alone for x in getattr(one, field).tolist()]
    forgetful = pieces.PieceModel(path, 0.1, 1, memo_bytes=0)
    assert forgetful.encode(text).tolist() == coder.encode(text).tolist()
    plain = pieces.PieceModel(path)
    assert plain.encode(text).tolist() == [i for u in own for i in scanned(plain, pieces.MARK + u, None)[0]]
    assert max(coder.byte_ids) < 2**31 and coder.encode(text).dtype == np.int32
