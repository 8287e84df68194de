"""Each operator against a brute-force version, and its defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from qualis.llm import chat, decontam, extract, licenses, lm, order, packing, queries, repetition, simhash, substrings
from qualis.llm.tokens import byte_bpe, vocabulary, word_bpe

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_words long, kept boolean, `a.b` string, rk string, id int"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus():
    """Texts with copies, near copies, shared passages, repeats, blanks, nulls, odd characters."""
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(120)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    passage = prose(60)
    out = [prose(r.randint(60, 200)) for _ in range(20)]
    out += [out[0], out[0], out[1] + " more", out[2].replace(" ", "\n", 3), out[3].upper()]
    out += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(6)] + [passage, passage + " " + passage]
    out += [None, "", "   \n\t", "one", "two words", "ab " * 400, ("x y z\n" * 30), prose(3000),
            "A b\x1cc İstanbul K ΣΑΣ é 😀 ### $ | <tag> a  b", "Released under the MIT License. " + prose(60),
            "cc by nc CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3."]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, True, "x", "y", 3) for i, t in enumerate(corpus())]
    rows += [(None, "a null id " * 20, 7, False, None, None, None), (3, rows[3][1], 7, True, "x", "y", 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    texts = corpus()
    return spark.createDataFrame(
        [(1, texts[0][:200]), (2, "two words"), (10, "TWO, words!"), (2, "two words"), (5, None), (6, " ,.")],
        "item_id long, text string")


def rows_by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r.asDict(recursive=True))
    return out


def inputs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- license scan ---

def test_licenses_match_brute_force(docs, empty):
    found = rows_by_id(licenses.license_scan(docs))
    assert sum(map(len, found.values())) == docs.count()
    for i, text in inputs(docs):
        w = words_of(text)
        places = [(label, p) for label, phrase in licenses.PHRASES for k in [phrase.split()]
                  for p in range(len(w)) if w[p:p + len(k)] == k]
        for r in found[i]:
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert r["first_word"] == min((p for _, p in places), default=None)
            assert r["last_word"] == max((p for _, p in places), default=None)
            assert r["base_labels"] == ",".join(sorted({label for label, _ in places}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [r["labels"] for v in found.values() for r in v if r["labels"]].count("gpl") == 1
    assert licenses.license_scan(empty).count() == 0


def test_license_template_with_changed_words(spark):
    words = licenses.TEMPLATES[0][1].split()
    texts = [" ".join(words), " ".join(words[:9] + ["x", "y"] + words[9:20] + words[21:]),
             " ".join(words[:12]), " ".join(reversed(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in licenses.license_scan(df).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and 0.9 < got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0)


def test_sibling_licenses_are_told_apart(spark):
    cc = "This work is licensed under a Creative Commons Attribution%s 4.0 International License."
    gnu = ("This %s is free software; you can redistribute it and/or modify it under the terms of the GNU %sGeneral "
           "Public License as published by the Free Software Foundation")
    cases = [(cc % "", "cc-by"), (cc % "-ShareAlike", "cc-by-sa"), (cc % "-Share Alike", "cc-by-sa"),
             (cc % "-NonCommercial", "cc-by-nc"), (cc % " Non-Commercial", "cc-by-nc"),
             (cc % "-NonCommercial-ShareAlike", "cc-by-nc,cc-by-sa"), (cc % "" + " " + cc % "-ShareAlike", "cc-by,cc-by-sa"),
             (gnu % ("program", ""), "gpl"), (gnu % ("library", "Lesser "), "lgpl"), (gnu % ("program", "Lesser "), "lgpl"),
             (gnu % ("library", ""), "gpl"), (gnu % ("program", "") + ". " + gnu % ("library", "Lesser "), "gpl,lgpl"),
             ("This work is licensed under the GNU Lesser General Public License version 3", "lgpl")]
    cases += [("some words before " + t.replace("is", "was", 1) + " and after", labels) for t, labels in cases[:4]]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}
    assert got == {i: labels for i, (_, labels) in enumerate(cases)}


def test_license_scan_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text
    texts = ["Released under the MIT License.", "no license", "", None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.license_scan(df.select("doc_id", F.udf(seen, "string").asNondeterministic()("text").alias("text")))
    assert [r.n_words for r in sorted(found.collect())] == [5, 2, 0, 0] * 5
    assert read.value == len(texts)


def test_license_places_in_stretches_apart(spark):
    """Phrases and templates with all gaps around the length of the longest template, at both ends of texts."""
    reach = max(len(t.split()) for _, t in licenses.PHRASES + licenses.TEMPLATES)
    phrase, template = licenses.PHRASES[1][1], licenses.TEMPLATES[2][1]
    texts = [f"{phrase} {'word ' * gap}{phrase.upper()} {'word ' * (3 * reach)}{template} {'word ' * gap}{phrase}"
             for gap in range(2 * reach + 3)]
    texts += ["under the mit", "license", "cc by", "nc cc by nc"]  # k-grams over the ends of neighbouring rows
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    m, k = len(template.split()), len(phrase.split())
    for gap in range(2 * reach + 3):
        r = got[gap]
        assert (r.n_words, r.n_base, r.first_word) == (3 * k + 2 * gap + 3 * reach + m, 3, 0)
        assert (r.last_word, r.base_labels, r.labels, r.score) == (r.n_words - k, "apache-2", "apache-2,bsd", 1.0)
    assert [got[i].n_base for i in range(gap + 1, len(texts))] == [0, 0, 0, 1] and got[len(texts) - 1].first_word == 1


# --- decontamination ---

def brute_hits(text, items, n=10):
    w, hit, ids = words_of(text), set(), set()
    for i, item in items:
        v = words_of(item)
        for k in range(max(1, len(v) - n + 1) if v else 0):
            win = v[k:k + n]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("max_bytes", [decontam.MAX_BYTES, 700])
def test_decontamination_matches_brute_force(docs, empty, bench, max_bytes):
    items = [tuple(r) for r in bench.collect()]
    found = rows_by_id(decontam.contamination(docs, bench, max_bytes=max_bytes))
    assert sum(map(len, found.values())) == docs.count()
    for i, text in inputs(docs):
        for r in found[i]:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(text, items)
            assert r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"])
            for s in r["spans"]:
                part = text[s["char_start"]:s["char_end"]]
                assert words_of(part) == words_of(text)[s["first_word"]:s["end_word"]]
    kept = decontam.clean_documents(docs, bench, max_bytes=max_bytes)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
        str(i) for i, v in found.items() for r in v if not r["contaminated"])
    assert decontam.contamination(empty, bench).count() == 0
    none = decontam.contamination(docs, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


# --- training order ---

@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_permutation(n):
    got = order.permuted(np.arange(n), n, "k")
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != order.permuted(np.arange(n), n, "other")).any() and (got != np.arange(n)).mean() > 0.9


def test_order_round_trip(docs, empty, tmp_path):
    uri = str(tmp_path / "out")
    rows = order.write_in_order(docs, uri, key="7", length=64, shard_rows=8).collect()
    bpe = byte_bpe(vocabulary("byte_bpe_50k.tiktoken"))
    want = Counter()
    for _, text in inputs(docs):
        want.update(bpe.encoding.encode_ordinary(text or "") + [bpe.size])
    read = list(order.read_slots(uri, 0, len(rows), length=64, shard_rows=8))
    got = Counter()
    by_slot = sorted(rows, key=lambda r: r.slot)
    assert [r.slot for r in by_slot] == list(range(len(rows)))
    for r, ids in zip(by_slot, read):
        assert zlib.crc32(ids.tobytes()) == r.crc32 and r.byte_offset == r.slot % 8 * 128
        got.update(ids[:r.n_tokens].tolist())
    assert got == want
    again = [x.tolist() for x in order.read_slots(uri, 11, 9, length=64, shard_rows=8)]
    assert again == [x.tolist() for x in read[11:20]]
    assert order.write_in_order(empty, str(tmp_path / "none")).count() == 0


# --- repetition ---

def brute_repetition(text):
    text = text or ""
    w = SPACE.findall(text)
    n = len(w)
    grams = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    rep = {j for i in range(n - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    base = n < 50 or 100 * len(rep) > 50 * n
    m = repetition.MIN_REPEAT
    longest, spans = 0, set()
    at = defaultdict(list)
    for i in range(n - m + 1):
        at[tuple(w[i:i + m])].append(i)
    for starts in at.values():
        for i in starts:
            best = 0
            for j in starts:
                k = 0
                while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            if best:
                spans.update(range(i, i + best))
                longest = max(longest, best)
    kept = not base and len(spans) <= repetition.MAX_COVERED * n and longest <= repetition.MAX_LONGEST * n
    return dict(n_words=n, word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)),
                n_dup_lines=dup, n_repeat_words=len(rep), n_covered_words=len(spans), longest_repeat=longest,
                base_failed=base, kept=kept)


def test_repetition_matches_brute_force(docs, empty):
    found = rows_by_id(repetition.repetition(docs))
    assert sum(map(len, found.values())) == docs.count()
    for i, text in inputs(docs):
        for r in found[i]:
            assert {k: r[k] for k in r if k != "doc_id"} == brute_repetition(text)
    kept = repetition.keep_unrepetitive(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for v in found.values() for r in v)
    assert repetition.repetition(empty).count() == 0 and repetition.keep_unrepetitive(empty).count() == 0


def test_longest_repeats_random():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(0, 2) for _ in range(r.randint(0, 30))] + [9]
        want = [max((next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0)
                     for j in range(len(s)) if j != i), default=0) for i in range(len(s))]
        assert repetition.longest_repeats(np.array(s)).tolist() == want


# --- main text ---

PAGES = [
    ("<html><nav><a>one two</a> three four five six</nav><div class='ad banner'>buy this now please</div><article><h1>Head &amp; line</h1>"
     "<p>First <b>bold</b>\n text.<br>next</p><script>var x='</p>';</script><aside>not this</aside><p>Second&nbsp;one</p>"
     "</article><div id='comments'><p>reader says many words here indeed</p></div><footer>foot words here</footer></html>",
     "Head & line\nFirst bold text. next\nSecond one"),
    ("<body><ul><li><a href='x'>Home</a><li><a>News</a></ul><div class='content'><p>" + "word " * 30 + "</p><form>mail me<input></form><p>"
     + "end " * 30, ("word " * 30).strip() + "\n" + ("end " * 30).strip()),
    (None, ""), ("", ""), ("<p", ""), ("<!-- only", ""), ("plain text &lt;b&gt;", "plain text <b>"),
    ("<article><p>cut off &am", "cut off &am"), ("<nav>a b c", ""),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)],
                                  "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract.main_texts(pages, extract.fit_prices(pages)).collect()}
    assert {i: got[i].text for i in got} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    none = pages.where("false")
    assert extract.main_texts(none, extract.fit_prices(none)).count() == 0


def test_main_text_held_out(spark):
    """Fitted on some labelled pages, right on the others."""
    import html
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    prices = extract.fit_prices(pages.where("page_id % 5 = 0"))
    bad = 0
    for r in extract.main_texts(pages, prices).join(pages.select("page_id", "html"), "page_id").where("page_id % 5 > 0").collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", m)]
        bad += r.text != "\n".join(filter(None, blocks))
    assert bad == 0


def test_wrappers_and_comment_lists(spark):
    """A wrapper with a boilerplate name keeps its article; <article> entries of a comment list stay out."""
    body = "<h1>Head</h1><p>" + "word " * 40 + "</p><p>" + "end " * 40 + "</p>"
    text = "Head\n" + ("word " * 40).strip() + "\n" + ("end " * 40).strip()
    reader = "<ol class='comments'>" + ("<li><article><p>" + "reader " * 300 + "</p></article></li>") * 3 + "</ol>"
    pages = [f"<body><div class='layout with-sidebar'>{body}<div class='sidebar'>links here</div></div></body>",
             f"<body><article>{body}</article>{reader}</body>", f"<body><div class='page'>{body}</div>{reader}</body>",
             f"<body><article>{body}<div class='comments'>unclosed</article>{reader}</body>",
             f"<body>{body}<div class='share'><nav>x</div>" + "<div class='ad'>" * 3000 + "</body>"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.main_texts(df, extract.fit_prices(df)).collect()}
    assert got == {i: text for i in range(len(pages))}


# --- language model ---

def test_lm_matches_brute_force(docs, empty):
    rows = {(i, t): words_of(t) for i, t in inputs(docs)}
    times = Counter(inputs(docs))
    n = Counter(w for k, v in rows.items() for w in v * times[k])
    total = sum(n.values())
    uni = n
    own = {k: Counter(zip(v, v[1:])) for k, v in rows.items()}
    bi = sum((own[k] for k in own for _ in range(times[k])), Counter())
    for keys in (7, 1 << 20):
        got = lm.backoff_scores(docs, group_keys=keys).collect()
        assert len(got) == docs.count()
        want = defaultdict(list)
        for (i, _), g in own.items():
            s = sum(c * np.log((bi[x] - c) / uni[x[0]] if bi[x] > c else 0.4 * uni[x[1]] / total) for x, c in g.items())
            want[i].append(None if not g else round(s / sum(g.values()), 9))
        for r in got:
            assert (None if r.score is None else round(r.score, 9)) in want[r.doc_id]
            assert r.n_bigrams == max(0, r.n_words - 1)
    assert lm.backoff_scores(empty).count() == 0


def test_lm_keeps_every_word(spark):
    """No vocabulary cut: rare words have counts of their own and back off."""
    r = random.Random(11)
    texts = [" ".join(r.choices(["the", "of", "a", "sea", "was", "and", "it", "blue"], k=700)) for _ in range(100)]
    texts += [" ".join(f"w{r.randrange(10**9)}" for _ in range(300)) for _ in range(3)]
    texts += ["rare1 rare2 the rare1 rare3", "rare1 rare2 of rare4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    split = [t.split() for t in texts]
    uni = Counter(w for v in split for w in v)
    own = [Counter(zip(v, v[1:])) for v in split]
    bi = sum(own, Counter())
    total = sum(uni.values())
    assert total > 2 * 32768  # a cut at 1 / 2**15 would take the words that occur once
    for keys in (1000, 1 << 20):
        got = {x.doc_id: x.score for x in lm.backoff_scores(df, group_keys=keys).collect()}
        for i, g in enumerate(own):
            s = sum(c * np.log((bi[x] - c) / uni[x[0]] if bi[x] > c else 0.4 * uni[x[1]] / total) for x, c in g.items())
            assert got[i] == pytest.approx(s / sum(g.values()), abs=1e-9)
        assert max(got[i] for i in (100, 101, 102)) < min(got[i] for i in range(100)) - 5


# --- substring dedup ---

def brute_removed(rows, n=13):
    big = 1 << 63
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            first[k] = min(first.get(k, big), big - 1 if i is None else i)
    out = defaultdict(list)
    for i, t in rows:
        w = SPACE.findall(t or "")
        off = {q for p in range(len(w) - n + 1) if first[tuple(w[p:p + n])] < (big - 1 if i is None else i)
               for q in range(p, p + n)}
        out[i].append((w, off))
    return out


@pytest.mark.parametrize("window", [1, 2, 13])
def test_substrings_match_brute_force(docs, empty, window):
    rows = inputs(docs)
    want = brute_removed(rows, window)
    found = rows_by_id(substrings.repeated_substrings(docs, window=window))
    assert sum(map(len, found.values())) == len(rows)
    for i, v in found.items():
        sha = lambda w, off: hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in off).encode()).hexdigest()
        assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in v) == \
            sorted((len(w), len(off), sha(w, off)) for w, off in want[i])
    assert substrings.repeated_substrings(empty).count() == 0


def test_without_repeats_keeps_columns(docs, empty):
    out = substrings.without_repeats(docs, chars_col="n_words")
    assert out.columns == docs.columns and out.count() == docs.count()
    want = brute_removed(inputs(docs))
    for r in out.collect():
        assert SPACE.findall(r.text or "") in [[x for p, x in enumerate(w) if p not in off] for w, off in want[r.doc_id]]
    assert substrings.without_repeats(empty).count() == 0


def test_longest_repeat_doubles(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, shared), (2, shared + " tail"), (3, " ".join(f"w{i}" for i in range(30))),
                                (4, "other text"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.repeat_words for r in substrings.longest_repeats(df).collect()}
    assert got == {1: 52, 2: 52, 3: 26}


# --- SimHash ---

def brute_fp(text):
    w = SPACE.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs, empty):
    rows = inputs(docs)
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_components(fps)
    low = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in set(roots)}
    want = sorted((str(i), fp, str(low[r])) for (i, _), fp, r in zip(rows, fps, roots))
    got = sorted((str(r.id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in low.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_tiles_lose_no_link(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps):  # chains and dense groups around them
        for _ in range(12):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from qualis.llm.components import components
    roots = {x.node & (1 << 64) - 1: x.root for x in components(simhash.links(df, tile_rows=3)).collect()}
    want = brute_components(fps)
    got = [roots.get(f, f) for f in fps]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


# --- chat ---

def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "####", "a\\\\</turn>\\", "<|endoftext|> é 😀\n\n  ", "x" * 5000, ": \\: "]
    rows = [(c, t, r, x) for c in (1, None, -7) for t, (r, x) in
            enumerate((r, x) for x in odd for r in ("user", "assistant", "odd: ### role", None))]
    rows += [(9, None, "user", "null turn"), (9, 1, "user", "tie b"), (9, 1, "assistant", "tie a"), (8, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    path = vocabulary("byte_bpe_50k.tiktoken")
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, None, -7):
        turns = [(r or "", x or "") for k, _, r, x in rows if k == c]
        ids = np.frombuffer(made[c].ids, "<u4")
        assert chat.read_turns(ids, path) == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (back[c].n_turns, back[c].loss_chars) == (len(turns), len(loss))
        assert back[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert back[c].formatted_chars == sum(14 + len(chat.escape(r, True)) + len(chat.escape(x)) for r, x in turns)
    assert chat.read_turns(np.frombuffer(made[9].ids, "<u4"), path) == [
        ("user", "null turn"), ("assistant", "tie a"), ("user", "tie b")]
    assert back[8].loss_chars == 0
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_turns_stay_rows(spark):
    """One row per turn, also where one id, or the null id, has most of them; joined they are the conversation."""
    r = random.Random(2)
    rows = [(r.choice((None, 1, 1, 1, c)), r.choice((None, c % 50)), r.choice(("user", "assistant", None)),
             r.choice((None, "", "### x", "word " * (c % 9)))) for c in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = chat.format_turns(df)
    made = defaultdict(list)
    for t in turns.collect():
        made[t.conv_id].append(t)
    assert sum(map(len, made.values())) == len(rows)
    for whole in chat.format_conversations(df).collect():
        own = sorted(made[whole.conv_id], key=lambda t: t.seq)
        assert [t.seq for t in own] == list(range(whole.n_turns))
        assert [t.offset for t in own] == [sum(len(x.ids) // 4 for x in own[:i]) for i in range(len(own))]
        assert b"".join(t.ids for t in own) == whole.ids
        assert [x for t in own for x in t.loss_start] == whole.loss_start
        assert [x for t in own for x in t.loss_end] == whole.loss_end
    assert sorted(map(repr, chat.read_back(turns).collect())) == sorted(
        map(repr, chat.read_back(chat.format_conversations(df)).collect()))
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


# --- packing ---

@pytest.mark.parametrize("window,max_open", [(2048, 4096), (64, 5)])
def test_packing_round_trip(docs, empty, window, max_open):
    rows = packing.pack(docs, window=window, max_open=max_open).collect()
    tokenizer = word_bpe(vocabulary("word_bpe_49k.json")).tokenizer
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in inputs(docs))
    pieces, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
    n_tokens = 0
    for p in pieces.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0
        size = p[-1][0] + p[-1][1]
        assert size <= window and (size == window or size & (size - 1) == 0)  # no padding at all
        n_tokens += size
    assert n_tokens == sum(len(ids) * c for (_, ids), c in want.items())
    for (i, ids), c in want.items():
        got = Counter((s, tuple(x)) for s, x in by_doc[i, len(ids)])
        assert sum(len(x) * k for (_, x), k in got.items()) >= len(ids) * c
        assert all(tuple(x) == ids[s:s + len(x)] for (s, x) in got) or c < len([1 for j, _ in inputs(docs) if j == i])
    assert packing.pack(empty).count() == 0


def test_level_minimises_sum_of_squares():
    r = random.Random(2)
    for _ in range(300):
        p = packing.Packer(16)
        for h in range(1, 16):
            p.counts[h] = r.randint(0, 3)
        size = r.randint(1, 15)

        def after(h):
            c = p.counts.copy()
            c[h] -= h > 0
            c[h + size] += 1
            return (c[1:16] ** 2).sum()
        options = [h for h in range(0, 17 - size) if h == 0 or p.counts[h] > 0]
        assert after(p.level(size)) == min(map(after, options))


# --- tokens ---

def test_ids_equal_the_tokenizers():
    r = random.Random(1)
    alphabet = "aA bΣé́\n \t'sS1２.,!日  ẞßİKͅ😀\x00\x1c"
    values = ["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(3000)] + [
        "<|endoftext|> hi", "  lead", "trail  ", "a\r\n\r\n b\n \n c", *[t or "" for t in corpus()]]
    w, b = word_bpe(vocabulary("word_bpe_49k.json")), byte_bpe(vocabulary("byte_bpe_50k.tiktoken"))
    for encoder, one in ((w, lambda t: w.tokenizer.encode(t, add_special_tokens=False).ids),
                         (b, b.encoding.encode_ordinary)):
        ids, counts = encoder.encode(values)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [list(one(t)) for t in values]
    assert b.decode(b.encode(["é 😀\n x"])[0]) == "é 😀\n x"


# --- queries and pipeline ---

def test_pipeline_stages(spark, docs, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, " ".join(corpus()[5].split()[20:40]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    names = now.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, now.where("false"), sf).count() == 0
        out = stage(spark, now, sf)
        if name != "packing":
            assert out.columns == names
            before, out = now, spark.createDataFrame(out.collect(), now.schema)
            if name == "decontamination":
                assert 5 in [r.doc_id for r in before.collect()] and 5 not in [r.doc_id for r in out.collect()]
            if name == "substring_dedup":
                assert all(r.n_chars == len(r.text) for r in out.collect())
                seen = set()
                for r in sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id)):
                    w = SPACE.findall(r.text)
                    win = {tuple(w[i:i + 13]) for i in range(len(w) - 12)}
                    assert r.doc_id is None or not win & seen or len(w) < 200
                    seen |= win
        now = out
    assert now.agg(F.sum("length")).first()[0] > 0


def test_oracles(spark):
    import os
    import sys
    import duckdb
    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from check_oracle import digest
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        cur = con.execute(sql)
        assert digest(df.columns, [tuple(r) for r in df.collect()])[:2] == \
            digest([c[0] for c in cur.description], cur.fetchall())[:2], name


def test_null_ids_leave_one_of_a_component(spark):
    """Copies linked by steps of a few bits, all without ids, leave one; so does a hub with many neighbours."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)] + [" ".join(words[:k] + ["x"] + words[k + 1:]) for k in (0, 5, 399)] * 2
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, "another text of its own kind")], "doc_id long, text string")
    found = simhash.near_duplicates(df).collect()
    roots = {r.root for r in found if r.id is None}
    kept = simhash.one_of_each(df).collect()
    assert len(kept) == len(roots) + 1 and len({r.fp for r in found if r.id is None}) > len(roots)


def test_components_with_hubs(spark, monkeypatch):
    from qualis.llm import components as module
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 450)] + [(450, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {**{i: 0 for i in [*range(200), 450]}, **{i: 300 for i in range(300, 341)}, **{i: 400 for i in [*range(400, 450), 500]}}
    for hubs in (1, 5, 10 ** 9):
        monkeypatch.setattr(module, "HUBS", hubs)
        assert {r.node: r.root for r in module.components(df).collect()} == want
