"""Document operators against plain versions, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import bpe, language, packing, pii, simhash, substrings
from tideline.llm.exact_dedup import drop_copies, text_groups

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample_texts():
    rng = random.Random(5)
    words = ["the", "and", "river", "stone", "Éclair", "über", "naïve", "don't", "x9", "🎉"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(6000))
    shared = " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(60))
    base = " ".join(rng.choice(words) for _ in range(300))
    return [
        None, "", " \t\n", "a", "a b", "A b", "a b c d", "ab" * 200, "a" * 900, long, long, base, base + " end",
        base.replace("river", "River"), f"start one {shared} tail one", f"other {shared} rest of it", "same", "same", "same",
        "mail me: a.b@c.de or 10.0.0.1, 4111 1111 1111 1111, +49 (30) 1234-567", "1234567 !!! ???", "ends<|endoftext|>here",
        "Σίσυφος ΣΑΣ İ", "日本語 テキスト", "café café", "tab\x1cfs\x85nel",
    ]


@pytest.fixture(scope="module")
def texts():
    return sample_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[16], (None, "no id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    # Columns with the names that operators use inside.
    return df.withColumns({"kept": F.lit("x"), "_n": F.lit(1), "fp": F.lit("y"), "component_id": F.lit(0), "_key": F.lit(2), "score": F.lit("z"), "_k1": F.lit("k")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, top, len(ids), i == top, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in text_groups(docs).collect()) == want
    assert text_groups(empty).count() == 0
    assert Counter(r.text or "" for r in drop_copies(docs).filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()).most_common(1)[0][1] == 1
    assert drop_copies(docs).columns == docs.columns


def test_exact_groups_beyond_broadcast(docs, monkeypatch):
    from tideline.llm import exact_dedup

    want = Counter(tuple(r) for r in text_groups(docs).collect()), Counter(r.doc_id for r in drop_copies(docs).collect())
    monkeypatch.setattr(exact_dedup, "few", lambda df: False)
    assert (Counter(tuple(r) for r in text_groups(docs).collect()), Counter(r.doc_id for r in drop_copies(docs).collect())) == want


def test_only_texts_that_begin_alike_are_hashed(spark):
    rows = [(1, "same"), (2, "same"), (3, "diff"), (4, "x" * 200 + "a"), (5, "x" * 200 + "b"), (6, "longer")]
    got = text_groups(spark.createDataFrame(rows, "doc_id long, text string"), hash_all=False).collect()
    assert {r.doc_id for r in got if r.text_sha256} == {1, 2, 4, 5} and {r.doc_id for r in got if not r.kept} == {1}


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from tideline.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, empty):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count()
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    fps = {r.doc_id: plain_fingerprint(r.text or "") for r in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(fps, links)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_rows_without_id_are_exempt(spark):
    data = [(None, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "e f", "en", "s", 3)]
    df = spark.createDataFrame(data, SCHEMA)
    for drop, kept in ((drop_copies, [2, 2]), (simhash.drop_near_copies, [1])):
        assert Counter(r.doc_id for r in drop(df).collect()) == Counter([None, None, None, *kept])
        assert "Rows without an id are exempt" in drop.__doc__


def test_shingle_and_radius(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [words, [*words[:30], "new", *words[31:]], list(reversed(words)), words[:4]]
    data = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, SCHEMA)
    fps = [simhash.fingerprint(t.encode(), 5) for _, t, *_ in data]
    assert fps[0] != simhash.fingerprint(data[0][1].encode())
    radius = (fps[0] ^ fps[1]).bit_count()
    got = {r.doc_id: r for r in simhash.simhash_components(df, radius=radius, shingle=5).collect()}
    links = [(a, b) for a in range(4) for b in range(a + 1, 4) if (fps[a] ^ fps[b]).bit_count() <= radius]
    want = components(range(4), links)
    assert want[1] == 0 and {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in range(4)}
    assert {r.doc_id for r in simhash.drop_near_copies(df, radius=radius, shingle=5).collect()} == {i for i, c in want.items() if i == c}


def plain_shingles(text, n):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_texts(rng):
    """Bases with copies in which some words differ, on either side of a similarity of 0.8."""
    texts = []
    for n in [3, 6, 12, 40, 40, 150, 150, 400, 2000]:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
            copy = list(base)
            for i in rng.sample(range(n), max(1, round(n * share))):
                copy[i] = rng.choice(["changed", "", copy[i].upper(), f"v{rng.randint(0, 10**6)}"])
            texts.append("  ".join(w for w in copy if w))
    return texts


def test_similar_groups(spark, docs, empty):
    rng = random.Random(11)
    rows = [*enumerate(similar_texts(rng)), (500, None), (501, ""), (502, " "), (None, "no id"), (503, "a b c"), (503, "a b c")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "id": F.lit(1), "root": F.lit(2), "keys": F.lit(3)}).repartition(4)
    sets = {i: plain_shingles(t or "", 5) for i, t in rows if i is not None}
    fps = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in rows if i is not None}
    alike = [(a, b) for a in sets for b in sets if a < b and plain_jaccard(sets[a], sets[b]) >= 0.8]
    want = components(sets, alike + [(a, b) for a in sets for b in sets if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == want and len(alike) > 20 and len(set(want.values())) > 15
    kept = Counter(r.doc_id for r in simhash.drop_near_copies(df, shingle=5, similarity=0.8).collect())
    assert kept == Counter(i for i, _ in rows if i is None or want[i] == i)
    assert simhash.drop_near_copies(docs, shingle=5, similarity=0.8).columns == docs.columns
    assert simhash.similar_groups(empty).count() == 0


def test_a_large_group_of_similar_texts(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])) for i in range(3000) for at in [rng.randrange(120)]]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 3000 and {r.component_id for r in got} == {0}


def test_every_pair_of_a_crowd_is_a_candidate(spark):
    """Texts of one family, few pairs of which are similar enough: neither the nearest
    fingerprints nor the first texts name them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(400):
        text = list(base)
        for at in rng.sample(range(100), 2):
            text[at] = f"v{at}.{rng.randrange(3)}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    sets = {i: plain_shingles(t, 5) for i, t in rows}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    alike = [(a, b) for a in sets for b in range(a) if plain_jaccard(sets[a], sets[b]) >= 0.84]
    want = components(sets, alike + [(a, b) for a in sets for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 1])
    assert len(set(want.values())) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, similarity=0.84, radius=1).collect()}
    assert got == want


def test_the_pairs_of_a_family_are_not_written(spark, monkeypatch):
    """Nearly all pairs of a family are just below the similarity: what leaves the workers grows with
    its texts, and the few pairs that are similar enough are found."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(0, 200, 5), 2):
            text[at] = f"v{at}.{i}"
        texts.append(" ".join(text))
    texts += [f"{t} end" for t in texts[::60]]
    sets = {i: plain_shingles(t, 5) for i, t in enumerate(texts)}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in enumerate(texts)}
    alike = [(a, b) for a in sets for b in range(a) if plain_jaccard(sets[a], sets[b]) >= 0.86]
    want = components(sets, alike + [(a, b) for a in sets for b in range(a) if (fps[a] ^ fps[b]).bit_count() == 0])
    compared, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(simhash, "FAMILY", 64, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, similarity=0.86, radius=0).collect()}
    assert got == want and len(set(want.values())) > 20
    assert max(compared) < 20 * len(texts)


def test_only_texts_that_can_have_a_partner_are_spread(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    texts += [" ".join([*texts[0].split()[:90], *(f"x{i}" for i in range(10))]), " ".join([*texts[1].split()[:50], *(f"y{i}" for i in range(50))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bitmap, common = simhash.shared_shingles(df, 5), simhash.common_shingles(df, 5)
    fields = "doc_id long, fp long, key binary, size long, skipped long, prefix array<long>"
    rows = df.mapInArrow(lambda it: simhash._signatures(it, 5, 0.8, common, bitmap), fields).collect()
    assert {r.doc_id for r in rows if r.prefix} == {0, 20}
    assert all(r.skipped + len(r.prefix) == 20 for r in rows if r.prefix)  # a prefix of 96 is 20


def test_vantage_shards_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    far = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = np.repeat(far[:30], 40) ^ (np.uint64(1) << rng.integers(0, 64, 1200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1200, dtype=np.uint64))
    chain = np.cumsum(np.ones(50, dtype=np.uint64)) * np.uint64(0)
    for i in range(1, 50):
        chain[i] = chain[i - 1] ^ (np.uint64(1) << np.uint64(i % 60))
    fps = np.unique(np.concatenate([far, near, chain]))
    df = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    links = []
    for i in range(len(fps)):
        links += [(i, int(j) + i + 1) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 2)]
    want = components(range(len(fps)), links)
    for sample in (1 << 15, 64):  # all levels fitted; two fitted and five below them
        got = {r.fp: r.component_id for r in simhash.near_duplicates(df, shard=40, sample=sample).collect()}
        assert all(got[int(x)] == want[i] for i, x in enumerate(fps.view(np.int64)))


def test_suffix_automaton_phrases():
    rng = random.Random(1)
    for _ in range(100):
        sample = "".join(rng.choice("ab ") for _ in range(40))
        text = "".join(rng.choice("abc ") for _ in range(25))
        root, n, at = language.SuffixAutomaton(sample).linked(), 0, 0
        while at < len(text):
            size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in sample), 1)
            at, n = at + size, n + 1
        assert language.phrases(root, text) == n


def plain_prediction(samples, text):
    """Longest pieces by search in the sample itself."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    tidy = lambda t: " " + " ".join("".join(c if re.match(r"[^\W\d_]", c) else " " for c in t.lower()).split()) + " "
    text, cost = tidy(text), {}
    for lang, rows in samples.items():
        sample, n, at = "".join(map(tidy, rows)), 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            at, n = at + size, n + 1
        cost[lang] = n * np.log2(len(sample) + 1) / len(text)
    best, second = sorted((c, lang) for lang, c in cost.items())[:2]
    return best[1], 1 - best[0] / second[0]


def test_language_predictions(spark, docs):
    """Whole predictions, pieces across words included, against plain search."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = language.learn(df)
    assert len(samples) == 4 and all(0 < len(v) <= language.SAMPLE_DOCS for v in samples.values())
    assert samples == language.learn(df.unionByName(df).repartition(3))
    model = language.Identifier(samples)
    texts = [r.text[i : i + 300] for r in df.orderBy("doc_id").limit(30).collect() for i in (0, 40)] + [r.text for r in docs.select("text").collect() if len(r.text or "") < 2000]
    for t in texts:
        got, want = model.predict(t), plain_prediction(samples, t)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9
    long = " ".join(r.text for r in df.filter("lang = 'fr'").collect()) * 8
    assert len(long) > 200_000 and model.predict(long)[0] == "fr"


def test_language_learns_from_long_documents_where_there_are_no_others(spark):
    rows = [(i, "ein langer text über die welt " * 400 if i % 2 else "a short text about the world", ("en", "de")[i % 2]) for i in range(60)]
    samples = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(samples["en"]) <= language.SAMPLE_DOCS and samples["de"]
    assert sum(map(len, samples["de"])) < language.SAMPLE_DOCS * language.SAMPLE_CHARS + 12_001


def test_language(spark, empty):
    rows = {"en": "the cat sat on the mat and there was nothing else to think about", "de": "der hund und die katze sind nicht über den zaun gesprungen"}
    data = [(i, rows[("en", "de")[i % 2]], ("en", "de")[i % 2], "s", 1) for i in range(80)]
    data += [(100, None, "en", "s", 0), (101, "12 !!", "en", "s", 0), (102, "die katze und der zaun", None, None, None), (None, "the mat", "de", "s", 0), (103, "", "en", "", 0)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"lang_pred": F.lit(1), "held_out": F.lit(2)})
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(80))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(80))
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "de", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    assert language.identify(empty).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.identify(df).filter("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_bpe(docs, empty, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    got = bpe.round_trip(docs, VOCABULARY).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.round_trip(empty, VOCABULARY).count() == 0
    encoded = bpe.encode_documents(docs.filter("doc_id = 19"), VOCABULARY)
    ids = np.frombuffer(encoded.first().ids, dtype="<u4").tolist()
    assert bpe.decode_ids(encoded, VOCABULARY).first().text == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [*range(0, 0x20000, 0x4000), 0xE0000])
def test_bpe_every_code_point(block):
    """Alone, inside a word, after a capital and before a combining mark."""
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(VOCABULARY), bpe.load(VOCABULARY)
    points = [chr(c) for c in range(block, block + 0x4000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 512):
        s = "".join(f"{c} a{c}b A{c} {c}\u0301e\n" for c in points[lo : lo + 512])
        assert np.frombuffer(own.encode(s), dtype="<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_bpe_random_strings():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(VOCABULARY), bpe.load(VOCABULARY)
    rng = random.Random(9)
    for _ in range(400):
        s = "".join(rng.choice("aabcdeinrst' é<|>/w🎉9.\n") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.encode(s), dtype="<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def plain_repeats(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats(docs, empty, group, monkeypatch):
    whole = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda keyed, width: whole(keyed, width, group))
    rows = docs.select("doc_id", "text").collect()
    want = plain_repeats([(r.text or "").encode() for r in rows], 200)
    got = Counter(tuple(r) for r in substrings.repeat_digests(docs).collect())
    assert got == Counter((r.doc_id, *w) for r, w in zip(rows, want))
    assert substrings.repeat_digests(empty).count() == 0
    kept = {r.doc_id: len(r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert all(kept[r.doc_id] == w[0] - w[1] for r, w in zip(rows, want) if r.doc_id is not None)


def test_run_length_index():
    rng = random.Random(3)
    for _ in range(150):
        width, letters = rng.choice([3, 8, 12]), rng.choice([b"a", b"ab", b"abcd"])
        c = [bytes(rng.choice(letters) for _ in range(rng.randint(width, 40))) for _ in range(rng.randint(1, 8))]
        seen = Counter(x[i : i + width] for x in c for i in range(len(x) - width + 1))
        want = [i + width <= len(x) and seen[x[i : i + width]] > 1 for x in c for i in range(len(x))]
        assert substrings.repeated_windows(c, width).tolist() == want


def plain_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for n, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, docs, empty):
    rng = random.Random(4)
    odd = ["a@b.c_d@e.f x@y.z..q@w.e", "1.2.3.4.5.6.7.8 300.1.2.3.4 0001.2.3.255", "4532-0151-1283-0366  12 0000000000000", "🎉é a@b.co 🎉+1234567890 foo@bar_b@q.w @@a@b.c"]
    odd += ["".join(rng.choice("ab1234567890.@+- ()_é") for _ in range(rng.randint(5, 120))) for _ in range(150)]
    df = docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, kept string"))
    got = pii.personal_data(df).collect()
    want = Counter()
    for r in df.collect():
        s = plain_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want[r.doc_id, *(sum(x[1] == n for x in s) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert pii.personal_data(empty).count() == 0


def test_context_discovers_identifiers(spark):
    rows = [(i, f"please call my number {'+49 301234' + str(100 + i)} today {i}") for i in range(30)]
    rows += [(100, "please call my number 0301-99887766 today"), (101, "the serial is 0301-99887766 only")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:22:35" and got[101] == ""


def test_masking(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co and 10.0.0.1."), (2, "none"), (3, "")], "doc_id long, text string")
    rows = pii.with_spans(df.withColumn("_key", F.sha2("text", 256)), "_key")
    got = {r.doc_id: r.t for r in pii.mask(rows, "text", "spans", "t").select("doc_id", "t").collect()}
    assert got == {1: "é mail [EMAIL] and [IP].", 2: "none", 3: ""}


def test_masking_of_random_spans(spark):
    rng = random.Random(3)
    data = []
    for i in range(12):
        text = "".join(rng.choice("abcé🎉 ") for _ in range(rng.choice([10, 4096, 9000, 20_000])))
        spans = sorted((s, rng.randint(0, 4), min(len(text), s + rng.choice([1, 7, 5000]))) for s in rng.sample(range(len(text)), rng.choice([0, 1, min(9, len(text)), min(700, len(text))])))
        data.append((i, text, [dict(zip("ske", x)) for x in spans]))
    df = spark.createDataFrame(data, "doc_id long, text string, spans array<struct<s:int,k:int,e:int>>")
    got = {r.doc_id: r.t for r in pii.mask(df, "text", "spans", "t").collect()}
    for i, text, spans in data:
        want, at = "", 0
        for x in spans:
            if x["s"] >= at:
                want += text[at : x["s"]] + f"[{[*pii.KINDS, 'id'][x['k']].upper()}]"
            at = max(at, x["e"])
        assert got[i] == want + text[at:]


def plain_added(rows):
    """All spans by a plain version of the bootstrap."""
    found, edges = {}, defaultdict(set)
    for i, text in rows:
        base = plain_spans(text)
        ids = [m.span() for m in re.finditer(r"(?<![0-9A-Za-z])(?=[A-Za-z]*[0-9])[0-9A-Za-z][0-9A-Za-z_-]{5,63}(?![0-9A-Za-z_-])", text)]
        ids = [(s, e) for s, e in ids if sum(c.isdigit() for c in text[s:e]) >= 4 and not any(a < e and s < b for a, _, b, _ in base)]
        found[i] = [(a, b, True) for a, _, b, _ in base] + [(s, e, False) for s, e in ids]
    contexts = {}
    for i, text in rows:
        for s, e, seed in found[i]:
            ahead, behind = text[max(0, s - pii.WIDTH) : s].lower(), text[e : e + pii.WIDTH].lower()
            squeeze = lambda x: re.sub(r"\s+", " ", x)
            two, last, first = re.search(r"\S+\s+\S+\s*$", ahead), re.search(r"\S+\s*$", ahead), re.search(r"^\s*\S+", behind)
            own = ["l " + squeeze(two[0])] if two else []
            own += ["a " + squeeze(last[0]) + "\t" + squeeze(first[0])] if last and first else []
            contexts[i, s, e] = own
            for p in own:
                edges[p].add((text[s:e].lower(), seed))
    score = {}
    for p in edges:
        kinds = defaultdict(bool)
        for v, seed in edges[p]:
            kinds[v] |= seed
        score[p] = kinds
    score = {p: k for p, k in score.items() if sum(k.values()) >= pii.SUPPORT}
    value = {(p, v): float(seed) for p, k in score.items() for v, seed in k.items()}
    for n in range(pii.ROUNDS):
        conf = {p: np.mean([value[p, v] for v in k]) for p, k in score.items()}
        if n < pii.ROUNDS - 1:
            none = defaultdict(lambda: 1.0)
            for p, k in score.items():
                for v in k:
                    none[v] *= 1 - min(conf[p], 0.99)
            value = {(p, v): 1.0 if score[p][v] else (1 - none[v] if 1 - none[v] >= pii.CONFIDENCE else 0.0) for p, v in value}
    good = {p for p, c in conf.items() if c >= pii.CONFIDENCE}
    out = {}
    for i, text in rows:
        spans = [(a, k, b) for a, k, b, _ in plain_spans(text)]
        spans += [(s, 4, e) for s, e, seed in found[i] if not seed and good & set(contexts[i, s, e])]
        out[i] = ",".join(f"{[*pii.KINDS, 'id'][k]}:{s}:{e}" for s, k, e in sorted(spans))
    return out


def test_added_spans_are_those_of_a_plain_version(spark):
    rng = random.Random(7)
    frames = ["call my number {} today", "account no {} closed", "mail to {} at once", "the serial {} only", "ref {}"]
    secret = lambda: rng.choice([f"+49 30{rng.randint(10**6, 10**7)}", f"a{rng.randint(0, 99)}@b.de", f"X{rng.randint(1000, 1040)}-{rng.randint(10, 99)}", "word"])
    rows = [(i, " ".join(rng.choice(frames[: 1 + i % 5]).format(secret()) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    rows += [(1000 + i, f"dial my line +49 30555{1000 + i} now, please") for i in range(20)] + [(1100 + i, f"dial my line Q{7000 + i}-AB now, please") for i in range(3)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_added(rows)
    assert got == want and any("id:" in s for s in want.values())


def test_a_text_with_a_hundred_thousand_matches(spark):
    text = " ".join(f"u{i}@mail.example 10.0.{i % 256}.7 ref-{100000 + i}" for i in range(34_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.personal_data(df).first()
    assert (r.n_email, r.n_ip) == (34_000, 34_000)
    want = plain_spans(text)
    assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest() == r.base_sha256


def test_best_boundaries():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(60):
        bins = [(b, rng.randint(1, 9), 0) for b in sorted(rng.sample(range(1, 30), rng.randint(1, 8)))]
        bins = [(b, n, n * (b * 16 - rng.randint(0, 15))) for b, n, _ in bins]
        k = rng.randint(1, 4)

        def padding(ends):
            return sum(n * min(e for e in ends if e >= b * 16) - t for b, n, t in bins)

        tops = [b * 16 for b, _, _ in bins]
        best = min(padding([*c, tops[-1]]) for r in range(k) for c in combinations(tops[:-1], min(r, len(tops) - 1)))
        got = packing.best_boundaries(bins, k, 16)
        assert got == sorted(set(got)) and len(got) <= k and padding(got) == best
    assert packing.best_boundaries([], 3, 16) == []


def test_pack_is_optimal_over_lengths(spark):
    from itertools import combinations

    rng = random.Random(8)
    lengths = [rng.choice([3, 17, 18, 33, 40, 65, 66, 97, 129]) for _ in range(60)] + [17] * 40 + [129]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    tops = sorted(set(lengths))
    padding = lambda ends: sum(min(e for e in ends if e >= n) - n for n in lengths)
    for k in (1, 2, 3, 4):
        best = min(padding([*c, tops[-1]]) for r in range(k) for c in combinations(tops[:-1], r))
        assert sum(r.padding for r in packing.pack(df, buckets=k).collect()) == best


def plain_packing(rows, max_len, buckets, budget):
    """Pieces, boundaries over all choices, and how many pieces each batch of a bucket holds."""
    from itertools import combinations

    pieces = [min(max_len, len(t) - k * max_len) for t in rows for k in range(max(1, -(-len(t) // max_len)))]
    tops = sorted({max(1, n) for n in pieces})
    cost = lambda ends: sum(min(e for e in ends if e >= n) - n for n in pieces)
    best = min(cost([*c, tops[-1]]) for r in range(min(buckets, len(tops))) for c in combinations(tops[:-1], r))
    return pieces, best


def test_packing_is_that_of_a_plain_version(spark):
    rng = random.Random(12)
    texts = ["é" * rng.choice([0, 1, 5, 9, 30, 31, 64, 200]) for _ in range(70)]
    rows = [(rng.choice([None, 1, 1, i]), t) for i, t in enumerate(texts)] + [(1, "é" * 9)] * 25
    pieces, best = plain_packing([t.encode() for _, t in rows], 100, 3, 250)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), max_len=100, buckets=3, budget=250, shards=4).collect()
    assert Counter(r.n_tokens for r in got) == Counter(pieces) and sum(r.padding for r in got) == best
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in rows)
    ends = sorted({r.bucket_len for r in got})
    for r in got:
        assert r.bucket_len == min(e for e in ends if e >= r.n_tokens) and r.bucket == ends.index(r.bucket_len)
    for e in ends:
        n, per = sum(r.bucket_len == e for r in got), max(1, 250 // e)
        filled = Counter(r.batch for r in got if r.bucket_len == e)
        assert filled == Counter({b: min(per, n - b * per) for b in range(-(-n // per))})


def test_packing_spreads_repeated_ids(spark):
    df = spark.createDataFrame([(None, "abc")] * 500, "doc_id long, text string")
    assert Counter((r.batch, r.slot) for r in packing.pack(df, budget=30).collect()) == Counter((i // 10, i % 10) for i in range(500))


def test_pack(docs, empty):
    got = packing.pack(docs, max_len=512, budget=2048, buckets=4, shards=3).collect()
    sizes = Counter()
    for r in got:
        sizes[r.doc_id] += r.n_tokens
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id] += len((r.text or "").encode())
    assert sizes == want
    assert all(0 <= r.padding == r.bucket_len - r.n_tokens and r.n_tokens <= 512 for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) * rows[0].bucket_len <= max(2048, rows[0].bucket_len)
    per_bucket = defaultdict(list)
    for (bucket, batch), rows in sorted(batches.items()):
        per_bucket[bucket].append(len(rows))
    assert all(n == v[0] for v in per_bucket.values() for n in v[:-1])
    assert packing.pack(empty).count() == 0
