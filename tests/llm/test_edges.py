"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, per operator."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import ann, exact_dedup, language_id, line_dedup, mixing, pii, sentencepiece_bpe, simhash, url_rules, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, `_id` string, root int"
LONG = "word " * 30_000 + "\n" + "x" * 5_000
TEXTS = [
    None, "", "   \n ", "a", "12 34 !!", "The same line of some length here\nand one more line that is long enough",
    "The same line of some length here\nand one more line that is long enough", "The same  line of some length here", LONG, LONG + "y",
    "the quick brown fox jumps over the lazy dog", "der schnelle braune fuchs springt über den hund",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if t and "ü" in t else ("en" if i % 4 else None), f"s{i % 3}" if i % 5 else None, len(t or ""), "k", 1, "z", 2) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s1", 3, "k", 1, "z", 2), (5, "other text with the same number", "en", "s1", 3, None, None, None, None)]
    rows += [(None, TEXTS[5], "en", None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    for group in by.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
        assert {r["keep_id"] for r in group} == {min(ids) if ids else None}
        assert next(r["doc_id"] for r in group if r["kept"]) == (min(ids) if ids else None)
    blank = hashlib.sha256(b"").hexdigest()
    assert len(by[blank]) == 3  # two nulls and the empty text; blanks become one space
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_splits_hot_texts(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}") for i in range(3000)] + [(1, "same text")]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hot = [r for r in found if r["group_size"] > 1]
    assert len(hot) == 2001 and {(r["keep_id"], r["group_size"]) for r in hot} == {(1, 2001)}
    assert [r["doc_id"] for r in hot if r["kept"]] == [1]
    assert sum(r["kept"] for r in found) == 1001


def _edit_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_line_dedup_against_all_pairs(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.choice([12, 19, 20, 21, 33, 70, 300, 900]))).strip() for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(6):
            line = rnd.choice(base)
            at = rnd.randrange(len(line) + 1)
            line = rnd.choice([line, line[:at] + "é" + line[at:], line[:at] + line[at + 1:], line[:at] + "Z" + line[at + 1:], line + "!", "", " "])
            lines.append(line)
        docs.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = []
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            norm = re.sub("[ \t-\r]+", " ", line).strip(" ")
            if not norm:
                kept.append(line)
                continue
            gone = any(s == norm or (min(len(s), len(norm)) >= 20 and _edit_one(s, norm)) for s in seen)
            seen.append(norm)
            if not gone:
                kept.append(line)
        assert got[i] == "\n".join(kept), i


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["text"] is None and by[1][0]["text"] == "" and by[2][0]["text"] == "   \n "
    assert by[6][0]["text"] == "" and not by[6][0]["has_lines"] and by[7][0]["text"] == ""
    assert by[9][0]["text"] == ""  # the long lines: one equal, one edit apart
    assert {r["text"] for r in by[5]} == {TEXTS[5], "other text with the same number"}  # repeated rows decide alike
    assert {r["text"] for r in by[None]} == {"", None}
    assert by[0][0]["row"]["kept"] == "k" and by[0][0]["row"]["row"] == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_simhash(docs, empty):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 5)}
    assert by[0]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert by[6]["component_id"] == 5 and by[9]["component_id"] == 8
    assert sum(r["first"] for r in rows) == len({r["component_id"] for r in rows}) + 1  # 5 leads two components
    assert simhash.first_of_groups(docs).count() == sum(r["first"] for r in rows)
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("limit", [2, 8, 4096])
def test_simhash_links_against_all_pairs(spark, limit):
    rnd, fps = random.Random(5), []
    for _ in range(40):
        at = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 12])):
            fps.append(at)
            for _ in range(rnd.randrange(4)):
                at ^= 1 << rnd.randrange(64)
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 3, limit)
    roots = {r["v"] % (1 << 64): r["root"] for r in simhash.components(links).collect()}

    want = {f: f for f in fps}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                want[find(a)] = find(b)
    for a in fps:
        for b in fps:
            assert (find(a) == find(b)) == (roots.get(a, a) == roots.get(b, b))


def test_sentencepiece(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sentencepiece_bpe.tokenise(docs, MODEL, with_ids=True).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in rows:
        options = [library.encode(t, add_bos=True, add_eos=True) for t in texts[r["doc_id"]]]
        assert r["ids"] in options and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r["ids"])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"]).encode()).hexdigest()
    assert len(rows) == docs.count() and sentencepiece_bpe.tokenise(empty, MODEL).count() == 0


def test_sentencepiece_on_odd_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.Encoder(MODEL)
    rnd = random.Random(1)
    texts = ["", " ", " a", "a ", "▁", "a▁b", "\t\n", "x" * 1000, "   " * 100, "日本語テキスト" * 60, "👍🏽é\0\ufeff", "<s> <0x0A>", "ab" * 700 + " zz"]
    texts += ["".join(rnd.choice("abcdethe \n▁é日👍") for _ in range(rnd.randrange(900))) for _ in range(150)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]
    assert [own.encode([t])[0].tolist() for t in texts] == [library.encode(t) for t in texts]


def test_language_id(docs, empty, spark):
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0
        if r["doc_id"] in (0, 1, 2, 4):
            assert r["lang_pred"] == "und" and r["score"] == 0.0
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de")
    assert language_id.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def _gram_set(text):
    """Grams of one to three characters with a letter, all else as spaces."""
    t = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} "
    return {g for n in (1, 2, 3) for i in range(len(t) - n + 1) if (g := t[i:i + n]).strip()}


def test_language_scores_equal_plain_kernel_ridge(spark):
    import zlib

    import numpy as np

    rnd = random.Random(5)
    words = {"xa": ["lorem", "ipsum", "dolor", "sit"], "xb": ["foo", "bär", "bazß", "qux"], "xc": ["人人", "生而", "自由", "的"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(2, 9))), lang) for i, lang in enumerate(list(words) * 12)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=1000, ridge=0.3)
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    sets = [_gram_set(t) for _, t, _ in used]

    def like(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b)) if a else 0.0

    k = np.array([[like(a, b) for b in sets] for a in sets])
    y = np.array([[float(r[2] == c) for c in sorted(words)] for r in used])
    alpha = np.linalg.solve(k + 0.3 * np.eye(len(k)), y)
    probes = ["lorem bär", "dolor sit ipsum", "自由 foo", "zzz yyy", "1 2 3 lorem"]
    want = np.array([[like(_gram_set(p), s) for s in sets] for p in probes]) @ alpha
    x = np.zeros((len(probes), language_id.SIZE), np.float32)
    for row, p in zip(x, probes):
        language_id.fill(row, p)
    assert model.languages == sorted(words) and np.allclose(model.scores(x), want, atol=0.02)


def test_language_repeated_identifiers_and_too_many_languages(spark, monkeypatch):
    rows = [(1, f"word{i % 3} and more", "en") for i in range(3000)] + [(i, "ein wort und mehr", "de") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"en", "de"}
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs)


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "xkcd qwrtz bcdfg hjklm npqrs tvwxz " * 8, " ".join(hashlib.sha1(bytes([i])).hexdigest() for i in range(20)),
    "for (int i = 0; i < n; ++i) { if (arr[i] == NULL) continue; ptr->next = malloc(sizeof(struct node)); } #include <stdio.h> void qsort_r(void *base, size_t nmemb);",
]
KNOWN = [
    "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "the", "the and of",
]


def test_language_stage_keeps_the_learned_languages_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10 ** 9 + i, t, None, "x", len(t)) for i, t in enumerate(FOREIGN + KNOWN)], docs.schema)
    kept = {r[0] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert not kept & {10 ** 9 + i for i in range(len(FOREIGN))}
    assert kept >= {10 ** 9 + len(FOREIGN) + i for i in range(len(KNOWN))}
    lost = {r[0] for r in docs.where("text rlike '[a-z]'").select("doc_id").collect()} - kept
    assert len(lost) <= 0.002 * docs.count()


def test_language_vote_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language_id.identify(docs, carry=["doc_id", "lang"]).where(language_id.in_fold(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found) > 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sources = {r["source"]: r for r in rows}
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["target"] for r in sources.values()) - total) < 1e-6
    for name, s in sources.items():
        own = [r for r in rows if r["source"] == name]
        assert s["target"] <= 3 * s["source_size"] + 1e-9
        assert abs(sum(r["size"] * r["copies"] for r in own) - s["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert all(r["copies"] <= 3 for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["order"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0
    blank = docs.withColumn("text", F.lit(" "))
    assert {(r["target"], r["copies"]) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_mixing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == 300
    for name in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == name]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 3.5 + 1e-6
        low = int(own[0]["target"] / own[0]["source_size"])
        assert {r["copies"] for r in own} <= {low, low + 1}


def test_pivotal_keeps_words_and_expectation():
    import numpy as np

    rng = np.random.default_rng(0)
    p, size = rng.random(9), rng.integers(1, 50, 9).astype(float)
    mean = np.zeros(9)
    for _ in range(4000):
        out, held = mixing.pivotal(p, size, rng.random(9))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != held)
        mean += out / 4000
    assert np.abs(mean - p).max() < 0.05


def test_targets_are_capped_and_shared_again(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), (None, 50), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights: a 1, b 2, c 3, null 1; b stops at 3 words and c at none
    assert got["b"] == 3 and got["c"] == 0 and abs(got["a"] - 74) < 1e-9 and abs(got[None] - 74) < 1e-9


def test_ann(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[300:330] = v[300]  # equal vectors
    v[0] *= 3  # one long vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] * 8), (2005, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, shard string")
    found = ann.nearest(df, df.where("vec_id % 10 = 0"), k=20, shard_rows=200).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 900, 10))
    scores, hits = v.astype(float) @ v.astype(float).T, 0
    for q, rs in by.items():
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r["vec_id"] for r in rs}
        assert all(abs(r["score"] - scores[q, r["vec_id"]]) < 1e-9 for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-scores[q, i], i))[:20]
        hits += len(set(order) & {r["vec_id"] for r in rs})
    assert hits >= 0.95 * 20 * len(by)
    monkeypatch.setattr(ann, "SHARDS_A_TASK", 2)  # a block's results then come from several tasks
    again = ann.nearest(df, df.where("vec_id % 10 = 0"), k=20, shard_rows=200).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/é\nb", same), (1, None, same), (1, "u", same), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", same),
            (6, "u", "é\r\n\r\nWARC/1.1" * 30), (7, "u", "y" * 3_000_000), (7, "u", "z" * 150)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"], r["url"]) for r in got if r["url"]) == sorted(
        (str(p), digest(h), len((h or "").encode()), u) for p, u, h in rows if u)
    group = [r for r in got if r["payload_digest"] == digest(same)]
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in group) == [
        ("1", "response", None), ("1", "revisit", 1), ("3", "revisit", 1), ("None", "revisit", 1)]
    assert {r["record_type"] for r in got if r["payload_digest"] != digest(same)} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reads_any_members():
    import gzip
    import io

    raw = [warc.record_bytes("response", {"A": "b"}, b"x" * n) for n in (0, 5, 70_000)]
    for packed in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        assert [r for _, _, r in warc.read_records(warc.inflate(io.BytesIO(packed)))] == raw
    with pytest.raises(ValueError):
        list(warc.read_records(iter([raw[1][:-20]])))


def test_url_rules(spark):
    urls = ["http://X.Example.org/es/1?a=b", "https://example.org/en/12#t", "http://example.org", "http://notexample.org/es/", "HTTP://a.COM/de/x", "b.com/fr/", None, "", "x://", "ftp://a.com?/fr/", "http://shop.bad-pills.net/en/1"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)] + [(0, urls[0], 0)], "page_id long, url string, rule int")
    bad = [("http://shop.bad-pills.net/en/7", True)] * 6 + [("http://fine.net/en/1", False)] * 20 + [("http://fine.net/en/1", None)]
    labelled = spark.createDataFrame(bad, "url string, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.url_verdicts(pages, labelled).collect()}
    assert got == {
        0: ("x.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "", None, "allow"),
        3: ("notexample.org", "/es/", "org/", "allow"), 4: ("a.com", "/de/x", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("a.com", "", None, "allow"), 10: ("shop.bad-pills.net", "/en/1", None, "block"),
    }
    assert url_rules.url_verdicts(pages, labelled).count() == len(urls) + 1
    assert url_rules.url_verdicts(pages.limit(0), labelled.limit(0)).count() == 0
    assert url_rules.url_verdicts(pages, labelled.limit(0)).where("verdict = 'block'").count() == 3 + 1


def _luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = ("Call +1 (988) 555-2485 or 555-323-4567 not 555-123-4567 or +49 30 1234 5678. Mail bos.bt_42@mail8.example.com, card 4041894974608795 / 4041-8949-7460-8795, "
            "not 4041894974608796, ip 70.123.182.155 not 300.1.1.1, ssn 123-45-6789 not 000-45-6789, iban GB82 WEST 1234 5698 7654 32 not GB83WEST12345698765432, "
            "on 2024-02-29, 02/29/2024, 29.02.2024, not 2023-02-29. sha 0641917ea4e9feb9cda83477b57ac2654884f485 v4.0.")
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "no data", 5), (5, "again 4041894974608795 " * 3000, 5), (1, text, 5), (None, "x 70.123.182.155", 5)], "doc_id long, text string, m int")
    rows = pii.pseudonymise(docs, "key").collect()
    by = {r["doc_id"]: r for r in rows}
    new = by[1]["text"]
    assert len(rows) == 7 and len({r["text"] for r in rows if r["doc_id"] == 1}) == 1
    for gone in ("988) 555", "555-323-4567", "1234 5678", "bos.bt_42", "4041894974608795", "4041-8949", "70.123.182.155", "123-45-6789", "5698 7654", "2024-02-29", "02/29/2024", "29.02.2024"):
        assert gone not in new, gone
    for stays in ("4041894974608796", "300.1.1.1", "000-45-6789", "GB83WEST12345698765432", "2023-02-29", "555-123-4567", "0641917ea4e9feb9cda83477b57ac2654884f485", "v4.0."):
        assert stays in new, stays
    card = re.search(r"card (\d{16}) / (\d{4}-\d{4}-\d{4}-\d{4})", new)
    assert card[1] == card[2].replace("-", "") and _luhn(card[1]) and card[1][0] == "4"
    assert by[5]["text"] == f"again {card[1]} " * 3000
    iban = re.search(r"iban (GB\d\d WEST \d{4} \d{4} \d{4} \d\d)", new)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    iso, us, de = (re.search(p, new) for p in (r"on (\d{4})-(\d\d)-(\d\d)", r"(\d\d)/(\d\d)/(\d{4})", r"(\d\d)\.(\d\d)\.(\d{4})"))
    assert iso.groups() == (us[3], us[1], us[2]) == (de[3], de[2], de[1])
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or [2-9]\d\d-[2-9]\d\d-\d{4} not 555-123-4567 or \+49 \d\d \d{4} \d{4}\.", new)
    assert re.search(r"Mail [a-z]{3}\.[a-z]{2}_\d\d@mail8\.example\.com,", new)
    assert by[None]["text"].split()[1] == re.search(r"ip (\S+)", new)[1]
    assert by[2]["text"] is None and by[3]["text"] == "" and by[4]["text"] == "no data" and by[4]["n_replaced"] == 0
    assert (by[1]["n_card"], by[1]["n_date"], by[1]["n_phone"], by[1]["n_email"], by[1]["n_ip"], by[1]["n_ssn"], by[1]["n_iban"]) == (2, 3, 3, 1, 1, 1, 1)
    assert pii.pseudonymise(docs, key="other").first()["text"] != rows[0]["text"]
    assert pii.pseudonymise(docs.limit(0), "key").count() == 0


def _valid_spans(text):
    """Every card and IBAN between separators, and every +1 number, by plain search."""
    out = set()
    for run in re.findall(r"(?<![A-Za-z0-9_+])[0-9](?:[ -]?[0-9])*(?![A-Za-z0-9_])", text):
        groups = re.split("[ -]", run)
        out |= {d for i in range(len(groups)) for j in range(i + 1, len(groups) + 1) if 13 <= len(d := "".join(groups[i:j])) <= 19 and _luhn(d)}
    words = text.split(" ")
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            w = "".join(words[i:j])
            if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", w) and int("".join(str(int(c, 36)) for c in w[4:] + w[:4])) % 97 == 1:
                out.add(w)
    return out | set(re.findall(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", text))


def test_nothing_valid_stays(spark):
    cards = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "3782-822463-10005", "6011 0009 9013 9424", "4222222222222"]
    ibans = ["BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"]
    rnd = random.Random(9)
    fillers = ["12", "123", "2024", "BIC", "WORD", "and", "0", "99-7", "x", "12/27", "+49 30 1234 5678", "AB12 3456"]
    texts = [" ".join(rnd.choice(rnd.choice([cards, ibans, fillers, fillers, ["+1 (123) 055-1234", "+1 (988) 555-2485"]])) for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    texts += ["card 4111 1111 1111 1111 12/27", "4111111111111111 123", "BE68 5390 0754 7034 BIC GEBABEBB", "+1 (123) 055-1234", "12 34 4111 1111 1111 1111 56", "AB12 4111 1111 1111 1111",
              " ".join(["7"] * 3000), "4111 1111 1111 1111 " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pseudonymise(docs, "key").collect():
        old, new = _valid_spans(texts[r["doc_id"]]), r["text"]
        gone = [v for v in old if v in re.sub("[ -]", "", new) or v in new]
        # what is part of a longer value that was replaced, or was made by a replacement, is no value left behind
        assert not [v for v in gone if any(v.replace(" ", "") == x.replace(" ", "").replace("-", "") for x in cards + ibans)], (texts[r["doc_id"]], new)
        assert not re.search(r"\+1 \(123\) 055-1234|\+1 \(988\) 555-2485", new) and len(new) == len(texts[r["doc_id"]])
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(docs, "")


def test_other_american_numbers_are_a_permutation(spark):
    numbers = [f"+1 ({a:03d}) {e:03d}-{n:04d}" for a, e in ((0, 0), (199, 999), (200, 199), (999, 0), (123, 456), (911, 111)) for n in range(0, 10_000, 500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(numbers)], "doc_id long, text string")
    new = [r["text"] for r in pii.pseudonymise(docs, "key").collect()]
    assert len(set(new)) == len(numbers) and not set(new) & set(numbers)
    for t in new:
        area, exchange = re.fullmatch(r"\+1 \(([0-9]{3})\) ([0-9]{3})-[0-9]{4}", t).groups()
        assert int(area) < 200 or int(exchange) < 200


def test_pseudonyms_are_permutations(spark):
    cards = [f"400000000000{i:04d}" for i in range(2000)]
    days = spark.range(400).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    for values in (spark.createDataFrame([(c,) for c in cards if _luhn(c)], "text string"), days):
        got = pii.pseudonymise(values.withColumn("doc_id", F.lit(1)), "key").collect()
        assert len({r["text"] for r in got}) == len(got) and all(r["n_replaced"] == 1 for r in got)
    out = spark.range(35).select(pii.feistel("k", "key", F.floor(F.col("id") / 7), F.col("id") % 7, 5, 7).alias("o")).collect()
    assert sorted(r["o"]["l"] * 7 + r["o"]["r"] for r in out) == list(range(35))


def test_pipeline_stages(spark, docs, empty, folder):
    for start in (docs, empty):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, folder)
            if name != "sentencepiece":
                assert out.columns == start.columns, name
                at = out.cache()
            out.count()
    assert corpus_pipeline.run(spark, folder).count() > 0
