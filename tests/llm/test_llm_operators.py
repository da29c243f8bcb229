"""Training-data operators against brute force, exact round trips, held-out accuracy and odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlsift.llm import ann, decontamination, language_model, mixing, near_dedup, quality, token_counts, token_ids, toxicity, warc

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "nt rl sto mi ék".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "Ünï  cödé x y, don't  stop<|endoftext|>!!\x1c?", "a" * 5000, "7 8\r\n\r\n99", "The the THE the."]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randint(1, 300)) for _ in range(60)), prose(rng, 30_000), ODD[4]]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(5)


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_packed_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 59, 60, 61, 4000):
        for top in (2, 4, 300, 40_000, 1 << 32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[rng.random(n) < 0.5] = 0
            words, escapes = token_ids.pack_block(ids)
            assert (token_ids.unpack(words, escapes) == ids).all()


def test_token_files_hold_what_the_library_gives(odd_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in token_ids.read_token_files(token_ids.write_token_files(odd_docs, path)).collect()}
    for doc_id, text in sorted(texts_of(odd_docs).items()):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), text[:50]
        start += len(ids)


def test_special_strings_keep_their_case():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for text in ("<|ENDOFTEXT|>", "One<|EndOfText|>TWO three", "<|endoftext|>", "A <|StartOfText|> B<| C|>"):
        got = next(token_ids.WordEncoder(path).encode([text.encode()]))
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_counts_are_the_library_s(odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, texts = Tokenizer.from_file(path), texts_of(odd_docs)
    for head in (0, 5, 1 << 17):  # whichever terms travel, the sums are the same
        for r in token_counts.count_tokens(odd_docs, path, head=head).collect():
            n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_language_model(odd_docs):
    training = F.col("doc_id") % 3 != 0
    texts = {i: t.encode().lower().split() for i, t in texts_of(odd_docs).items()}
    counts = Counter(w for i, words in texts.items() if i % 3 for w in [*words, b"\0end"])
    total, types = sum(counts.values()), len(counts)
    sums = [0.0, 0.0]
    for r in language_model.score_texts(odd_docs, training, symbols=20, head=25).collect():
        words = [*texts[r["doc_id"]], b"\0end"]
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert r["base_score"] == pytest.approx(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        sums = [sums[0] + r["base_score"], sums[1] + r["score"]]
    assert sums[1] > 1.01 * sums[0]  # words drawn alike and alone: there is nothing to gain


def test_language_model_learns_what_follows(spark):
    rng, rows = random.Random(9), []
    for i in range(200):
        at = rng.randrange(len(WORDS))
        rows.append((i, " ".join(WORDS[(at + 7 * j) % len(WORDS)] for j in range(100))))
    got = language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_model_tables_are_distributions():
    rng = np.random.default_rng(2)
    m = language_model.LogBilinear.start(np.full(40, 1 / 40), 8, 1)
    m.q[:], m.b[:] = rng.standard_normal(m.q.shape), rng.standard_normal(40)
    lead, norm = m.tables()
    p = 10.0 ** (lead[0][:, None, :] + lead[1][None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(-1), 1, atol=1e-4)


def brute_components(texts: dict[int, str], words: int) -> tuple[dict[int, int], dict[int, int]]:
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_are_the_brute_force_components(spark):
    rng = random.Random(4)
    texts = {i: prose(rng, rng.randint(20, 120)) for i in range(60)}
    for i in range(60, 260):
        w = texts[rng.randint(0, 20)].split() if i < 160 else texts[3].split()  # many near copies of one document
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts[i] = " ".join(w).upper() if i % 7 == 0 else " ".join(w)
    texts |= {1000 + i: t for i, t in enumerate(["", "  ", "one", "ONE", "one two", "one two three", "One\ttwo  three"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots, sizes = brute_components(texts, 4)
    for region in (1000, 40):
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, region=region).collect()}
        assert {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert {i: r["component_id"] for i, r in got.items()} == roots
        assert all(r["kept"] == (i == roots[i]) for i, r in got.items())


def test_one_link_between_two_families_joins_them(spark):
    texts = {}
    for family in (0, 1):
        for version in range(50):
            w = [f"w1x{i}" for i in range(300)]
            if family:
                w[100:130] = [f"other{j}" for j in range(30)]
            w[299] = "bridge" if version == 25 else f"v{family}x{version}"  # versions 25 are at 0.8, all others of two families below
            texts[family * 50 + version] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots, _ = brute_components(texts, 4)
    assert set(roots.values()) == {0} and set(brute_components({i: t for i, t in texts.items() if i != 25}, 4)[0].values()) == {0, 50}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == roots


def test_links_in_a_crowded_region_are_found(spark):
    rng, template = random.Random(7), [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(200):  # different texts on one template, any two of them below 0.8
        texts[i] = " ".join([*template, *(f"own{i}x{j}" for j in range(24))])
    for i in range(0, 60, 2):  # but thirty pairs, just above it
        w = texts[i].split()
        w[121:133] = [f"new{i}x{j}" for j in range(12)]
        texts[i + 1] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    roots, _ = brute_components(texts, 4)
    assert sum(i != r for i, r in roots.items()) == 30
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, region=20).collect()} == roots


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_mix_comes_to_its_targets(odd_docs):
    rows = mixing.mix(odd_docs).join(odd_docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    by = {s: [r for r in rows if r["source"] == s] for s in {r["source"] for r in rows}}
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"] and rs[0]["target"] <= 3 * rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.5 and all(0 <= r["taken"] <= 3 * r["size"] for r in rs)
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = mixed.select(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_nearest_reaches_its_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 16)) * rng.random((700, 1))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hits = 0
    for q in range(0, 700, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        scores = x @ x[q]
        true = [i for i in np.lexsort([np.arange(700), -scores]) if i != q][:10]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]]) for r in mine)
        hits += len(set(true) & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * 350
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0, k=10).collect()
    assert {r["vec_id"] for r in few} == {1, 2, 3, 4}
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_archive_round_trip(spark):
    big = "<p>ä</p>" * 3000
    rows = [(7, "http://a/ä?\r\n", big), (3, "u", big), (9, "u", "x" * 99), (10, "u", "x" * 99), (11, None, None), (12, "u", "y" * 100), (13, "u", "y" * 100), (3, "v", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(pages, chunk_bytes=1000)
    assert archive.where("chunks > 1").count() and archive.agg(F.max(F.length("data"))).first()[0] < 2000
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(archive).where("intact").collect())
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        head = min(p for p, _, h in rows if h == html)
        again = len(body) >= 100 and page != head
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", head if again else None))
    assert got == sorted(want)


def test_passages_with_few_edits_are_found(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(90, None), (91, "short"), (92, "")]
    docs = []
    for i in range(40):
        text = prose(rng, 80)
        if i < 8:
            leak = list(items[i][1])
            for _ in range(3 if i % 2 else 0):
                leak[rng.randrange(len(leak))] = rng.choice(["", "q", "zz"])
            text = text[:150] + " " + "".join(leak).upper() + " " + text[150:]
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, items[0][1][:45] + prose(rng, 50))]
    found = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(8)}


def test_alignment_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(60):
        w = bytes(rng.choice(b"abc") for _ in range(12))
        t = bytes(rng.choice(b"abc") for _ in range(18))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(w):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        got = decontamination.aligned(w, t, 12)
        assert got and got[0] == min(row)


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(700):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = prose(rng, rng.randint(20, 80))
        words = text.split() if good else [w.upper() + "!!" for w in text.split()]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "vileness", "grubby"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    model = quality.train_quality(docs, labels.where("doc_id % 4 != 2"))
    scored = docs.where("doc_id % 4 = 2").join(labels, "doc_id").select(quality.quality_score(model, F.col("text")).alias("s"), "quality").collect()
    assert np.mean([(r["s"] >= 0.7) == r["quality"] for r in scored]) > 0.97


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.train_toxicity(docs, labels.where("doc_id % 4 != 2"))
    scored = docs.where("doc_id % 4 = 2").join(labels, "doc_id").select(toxicity.toxicity_score(model, F.col("text")).alias("s"), "toxic").collect()
    assert np.mean([(r["s"] >= 0.3) == r["toxic"] for r in scored]) > 0.93


def test_toxicity_keeps_the_share_of_labels_when_sampled(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 8), "en") for i in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)], "doc_id long, toxic int")  # texts say nothing about them
    means = [toxicity_mean(docs, labels, rows) for rows in (6000, 400)]
    assert all(m < 0.25 for m in means) and abs(means[0] - means[1]) < 0.15, means


def toxicity_mean(docs, labels, rows):
    model = toxicity.train_toxicity(docs, labels, sample_rows=rows)
    return docs.agg(F.avg(toxicity.toxicity_score(model, F.col("text")))).first()[0]


def test_classifiers_take_odd_texts_and_no_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        q, t = quality.train_quality(odd_docs, labels), toxicity.train_toxicity(odd_docs, labels)
        for r in odd_docs.select(quality.quality_score(q, F.col("text")).alias("q"), toxicity.toxicity_score(t, F.col("text")).alias("t")).collect():
            assert 0 <= r["q"] <= 1 and 0 <= r["t"] <= 1


def test_empty_tables_give_no_rows(odd_docs):
    none = odd_docs.limit(0)
    assert token_ids.read_token_files(token_ids.write_token_files(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert language_model.score_texts(none, F.lit(True)).count() == 0
    assert decontamination.contaminations(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert warc.read_archive(warc.write_archive(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url")))).count() == 0


def test_long_texts_are_counted_in_parts(odd_docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, text = token_counts.pretokens_of(path), "  a b,c 12 3.\n\n x's  <|endoftext|> y  z\t" * 40
    whole = own.terms(own.counted(text.encode()))
    monkeypatch.setattr(token_counts, "PART", 50)
    assert own.terms(own.counted(text.encode())) == whole and sum(n * own.count(t.decode()) for t, n in whole.items()) == len(own.tokenizer.encode(text).ids)


def test_words_meet_the_cache_and_the_slices(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng, tokenizer = random.Random(9), Tokenizer.from_file(path)
    texts = [prose(rng, n) for n in (0, 1, 50, 400)] + ["x" * 90 + " " + prose(rng, 30), "A <|EndOfText|> b<|endoftext|> C", "\t", "ß Ünï \n cödé"] + [t or "" for t in ODD]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = token_ids.WordEncoder(path)
    encoder.cache = token_ids.WordCache(len(encoder.ends), bits=4)  # slots are taken from each other all the time
    for size in (1 << 20, 64):
        monkeypatch.setattr(token_ids, "SLICE", size)
        assert list(encoder.encode([t.encode() for t in texts])) == want
    assert (encoder.cache.keys > 0).any() and len(encoder.cache.keys) == 16


def test_links_of_repeated_ids_with_different_texts(spark):
    words = [f"w{i}" for i in range(60)]
    a, a2, b = " ".join(words), " ".join([*words[:-3], "x", "y", "z"]), " ".join(f"other{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a2), (3, b), (4, a), (5, "alone in this table of texts"), (6, "alone in this table of texts"), (6, "one more text by itself"), (7, "one more text by itself")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for (i, _), c in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5} and len(got) == 9
    hot = spark.createDataFrame([(8, f"text {i} with nothing in common {i}{i}") for i in range(50)] + [(9, "text 7 with nothing in common 77")], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(hot).collect()} == {8}


def test_revisits_refer_to_records_of_the_archive(spark):
    long, short = "x" * 300, "y" * 20
    pages = spark.createDataFrame([(3, "u", long), (1, "u", long), (2, "v", long), (1, "u", "z" * 150), (5, "w", "z" * 150), (4, "w", short), (6, "w", short), (None, "n", long)], "page_id long, url string, html string")
    archive = warc.write_archive(pages, chunk_bytes=64)
    heads = [bytes(r["data"]).split(b"\r\n\r\n")[0].decode() for r in archive.where("chunk = 0").collect()]
    field = lambda head, name: next((line.split(": ", 1)[1] for line in head.split("\r\n") if line.startswith(name + ": ")), None)
    responses = {field(h, "WARC-Record-ID"): field(h, "WARC-Payload-Digest") for h in heads if field(h, "WARC-Type") == "response"}
    revisits = [h for h in heads if field(h, "WARC-Type") == "revisit"]
    assert len(revisits) == 4 and len({field(h, "WARC-Record-ID") for h in heads}) == len(heads) == 8
    assert all(responses[field(h, "WARC-Refers-To")] == field(h, "WARC-Payload-Digest") for h in revisits)
    read = warc.read_archive(archive).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in read if r["refers_to"] is not None and r["page_id"] is not None) == [(2, 1), (3, 1), (5, 1)] and all(r["intact"] for r in read)


def test_leaks_with_other_spaces_short_ones_and_edits(spark):
    rng = random.Random(12)
    passage, question = prose(rng, 30), "What is the capital of Peru? Lima."
    items = [(1, passage), (2, question), (3, "Lima"), (4, None), (None, passage)]
    docs = [(1, prose(rng, 40) + "\n\n" + passage.replace(" ", "  \t") + " end"), (2, prose(rng, 30) + " " + question.upper() + " Right."), (3, "x" + question), (4, prose(rng, 80) + " Lima."),
            (5, passage[: len(passage) // 2] + "\r\n   " + passage[len(passage) // 2 :].lstrip()), (None, passage), (5, passage)]
    got = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (1, 1), (2, 2), (5, 1), (5, 1)]
    first = next(r for r in got if r["doc_id"] == 1)
    found = docs[0][1].encode().lower()[first["start"] : first["end"]].decode()
    assert " ".join(found.split()) == " ".join(passage.lower().split()) and next(r for r in got if r["doc_id"] == 2)["edits"] == 0
    for share, least in ((0.03, 0.98), (0.05, 0.9)):
        items = [(i, prose(rng, 50)) for i in range(60)]
        edited = []
        for i, text in items:
            chars = [rng.choice("abcdefg") if rng.random() < share else c for c in text]
            edited.append((i, prose(rng, 50) + " " + "".join(chars) + " " + prose(rng, 50)))
        got = decontamination.contaminations(spark.createDataFrame(edited, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert all(r["doc_id"] == r["item_id"] for r in got) and len(got) >= least * len(items)
