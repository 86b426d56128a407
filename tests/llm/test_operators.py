"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing names, no rows."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from hexloom.llm import (
    chat_format, decontamination, html_blocks, html_extraction, license_scan, media_sniffing, ngram_join, packing, pii_disclosure, quality_classifier, url_filter,
)
from hexloom.llm.byte_bpe import ByteBpe

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC).repartition(3)


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------------ 1


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def near_texts():
    base = words(120, 1)
    texts = [None, "", "  ", "One two", "one TWO", "a b c d e", "a b c d e", " ".join(words(6000, 2)), "É É é"]
    for k in range(90):  # a group of near copies, some at the edge of the similarity
        w = list(base)
        for j in random.Random(k).sample(range(120), k % 6):
            w[j] = f"x{k}_{j}"
        texts.append(" ".join(w))
    passage = words(60, 3)
    texts += [" ".join(words(80, 100 + k) + passage) for k in range(40)]
    texts += [" ".join(words(100, 200 + k)) for k in range(20)] + [" ".join(words(100, 200))] * 5
    return texts


@pytest.mark.parametrize("settings", [{}, {"FREQUENT": 4, "NEAR": 1, "BLOCK": 8, "PART": 8, "SALT_ROWS": 8, "LEAST": 4}, {"FREQUENT": 2, "NEAR": 0, "BLOCK": 2, "PART": 3, "TABLE_BITS": 7}])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_texts()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert found == brute_components(texts)


def test_large_groups_and_shared_passages_equal_brute_force(spark, monkeypatch):
    """Copies whose differences stand behind equal prefixes, and texts that share more than 5/6 with many others but link with few."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "PART", 32)
    base, passage = words(60, 11), words(89, 12)
    texts = [" ".join(base[:55] + [f"e{k % 7}"]) for k in range(40)] + [" ".join([*base, *words(k % 9, k)]) for k in range(200)]
    texts += [" ".join(passage + words(12 + k % 8, 500 + k)) for k in range(200)]
    r = random.Random(5)
    for _ in range(100):
        w = list(passage)
        for j in r.sample(range(89), r.randrange(4)):
            w[j] = f"y{r.random()}"
        texts.append(" ".join(w + words(5, r.randrange(10**6))))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert found == brute_components(texts)


def test_places_bound_the_overlap():
    """Against sets that share all behind their first shared shingle."""
    for na, nb, ia, ib in [(r.randrange(1, 60), r.randrange(1, 60), r.randrange(20), r.randrange(20)) for r in [random.Random(3)] for _ in range(400)]:
        if ia < na and ib < nb:
            most = min(na - ia, nb - ib)
            links = 100 * most >= 75 * (na + nb - most)
            assert bool(ngram_join.may_link(np.array([na << 31 | ia]), np.array([nb << 31 | ib]))[0]) == links


def test_rows_without_id_link_others(spark):
    """Of 1, null and 2, only the middle one is like both others."""
    w = words(100, 9)
    rows = [(1, " ".join(w)), (None, " ".join([*w[:88], *words(12, 10)])), (2, " ".join([*words(10, 12), *w[10:88], *words(12, 10)])), (None, "alone it is here today"), (None, None), (7, " ".join(w)), (7, "other words of one id here")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int")
    found = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    sets = brute_components([t for _, t in rows])
    assert {sets[i][1] for i in (0, 1, 2, 5)} == {0} and sets[6][1] == 6
    assert found == sorted([(1, 96, 1), (-1, 96, 1), (2, 96, 1), (7, 96, 1), (7, 2, 7), (-1, 1, None), (-1, 0, None)], key=str)


def test_one_of_each_keeps_the_least(spark):
    texts = near_texts()
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs_of(spark, texts)).collect())
    assert kept == sorted({c for _, c in brute_components(texts).values()})
    repeats = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "other words here"), (3, None), (3, None)]
    docs = spark.createDataFrame(repeats, "doc_id long, text string").withColumn("n", F.lit(0))
    left = ngram_join.one_of_each(docs)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "other words here"), (3, None)], key=str)
    assert ngram_join.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


# ------------------------------------------------------------------ 2


def test_chat_round_trip(spark):
    texts = [None, "", "plain", "</s>[INST] ok [/INST]", r"a\b", "ends\\", "<s><s>", r"\<s>", "[INST", "é 漢\n\n x", "<\\s>", "[/INST]</s>" * 50]
    rows = [(c, t, role, x) for c in range(3) for t, x in enumerate(texts) for role in (["user", "assistant", None][(t + c) % 3],)]
    rows += [(None, None, "assistant", "</s>"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat_format.format_chats(chats).collect()}
    assert len(out) == 5 and all(r.round_trip for r in out.values())
    for conv, r in out.items():
        source = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv))
        assert [(t.role, t.text) for t in r.turns] == [(s[2], s[3]) for s in source]
        for t in r.turns:
            for control in chat_format.CONTROLS:
                assert control not in r.formatted[t.start : t.end]
    assert chat_format.format_chats(chats.limit(0)).count() == 0


# ------------------------------------------------------------------ 3


def test_licenses(spark):
    texts = [None, "", "Words.\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 2.", "A licence to drive fast cars in the city of tomorrow."]
    got = {(r.doc_id, r.license, r.confirmed) for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    assert got == {(2, "MIT", True), (3, "Apache-2.0", True), (4, "GPL-2.0", True), (5, None, False)}
    row = license_scan.scan_licenses(docs_of(spark, texts)).where("doc_id = 2").first()
    assert texts[2][row.start : row.end] == row.block == "Released under the MIT License."


def test_wrapped_notices_are_whole():
    """Every wording of every template, alone and wrapped at 30 columns within prose and comments, is found as itself."""
    import textwrap

    for name, wordings in license_scan.TEMPLATES.items():
        for wording in wordings:
            plain = {r[0] for a, b in license_scan.candidate_blocks(wording) for r in license_scan.classify(wording[a:b]) if r[-1]}
            wrapped = "\n".join(textwrap.wrap(wording, 72))
            if all(line[:1].islower() or line[:1] == "(" for line in wrapped.split("\n")[1:]):
                for text in (f"Prose before.\n\n{wrapped}\n\nProse behind.", "Code.\n" + "\n".join("# " + line for line in wrapped.split("\n"))):
                    found = {r[0] for a, b in license_scan.candidate_blocks(text) for r in license_scan.classify(text[a:b]) if r[-1]}
                    assert found == plain, (name, text)


def test_long_licence_blocks():
    began, filler = time.time(), " ".join(words(60_000, 3))
    text = f"{filler} licensed under the MIT License {filler}"
    found = [row[0] for a, b in license_scan.candidate_blocks(text) for row in license_scan.classify(text[a:b])]
    assert found == ["MIT"] and time.time() - began < 60
    assert all(license_scan._CUE.search(w) for wordings in license_scan.TEMPLATES.values() for w in wordings)
    r = random.Random(1)
    for _ in range(200):
        a, b = ([str(r.randrange(4)) for _ in range(r.randrange(1, n))] for n in (6, 60))
        full = license_scan.aligned(a, b)
        found = license_scan.nearest_part(a, b, len(a) // 2)
        assert (found is None) == (len(full[0]) + len(full[1]) > len(a) // 2) and (found is None or len(found[0]) + len(found[1]) == len(full[0]) + len(full[1]))


def test_license_edges(spark):
    rows = [(None, "Released under the MIT License.", 1), (1, "Released under the MIT License.", 2), (1, "Released under the MIT License.", 2), (2, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    found = license_scan.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license) for r in found) == [(0, "MIT"), (1, "MIT"), (1, "MIT")]
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_all_licenses_of_a_block():
    named = lambda text: [row[0] for row in license_scan.classify(text)]
    assert named("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert named("Released under the MIT License. Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    text = "Copyright 2019 The Authors and Contributors of the project, all worldwide. Licensed under CC0 1.0. See the LICENSE file for the full license text of this work."
    assert named(text) == ["CC0-1.0"]


# ------------------------------------------------------------------ 4


@pytest.fixture(scope="module")
def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_byte_bpe_equals_the_tokenizer(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = ["", " ", "a  b\n\n c", "don't I'll 's ''s", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>z's<|endoftext", " <|endoftext|>\n\n ", "　x", "x   "] + ["".join(r.choice(" \n\tab1'.!éñ三½ st") for _ in range(r.randrange(40))) for _ in range(300)]
    assert [x.tolist() for x in ByteBpe(path).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_loses_nothing(spark, path):
    texts = [None, "", "x", " ".join(words(4000, 1))] + [" ".join(words(50 + 7 * k, k)) for k in range(60)]
    rows = packing.pack_documents(docs_of(spark, texts), path, batch_pieces=64).collect()
    wanted = [[*x.tolist(), packing.END_ID] for x in ByteBpe(path).encode([t or "" for t in texts])]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in enumerate(wanted):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids and {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert sum(r.length for r in pieces) <= packing.CAPACITY
    assert packing.pack_documents(docs_of(spark, texts).limit(0), path).count() == 0


def test_differencing_balances():
    sizes = [random.Random(k).randrange(1, 513) for k in range(700)]
    windows = packing.balanced(sizes, 2048)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(700)) and max(sums) <= 2048 and max(sums) - min(sums) < 60
    assert packing.balanced([2048] * 3 + [1], 2048) and packing.balanced([5], 2048) == [[0]]


# ------------------------------------------------------------------ 5


def test_banded_edits_equals_dynamic_programming():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            row, old = [i], row
            for j, d in enumerate(t, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return min(row)

    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, n))) for n in (12, 20))
        want, got = plain(p, t), decontamination.banded_edits(p, t, 4)
        assert (got[0] if got else None) == (want if want <= 4 else None)


def test_passages_are_found(spark):
    item = " ".join(words(40, 9))
    edited = list(item)
    for k in (20, 80, 150):
        edited[k] = "#"
    texts = [None, "", "before " + item + " after", item.upper().replace(" ", "\n  "), "x " + "".join(edited) + " y", " ".join(words(200, 10)), item[: len(item) // 2]]
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    got = decontamination.benchmark_passages(docs_of(spark, texts), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(2, 1, 0), (3, 1, 0), (4, 1, 3)]
    assert next(r.passage for r in got if r.doc_id == 2) == item
    kept = decontamination.without_passages(docs_of(spark, texts), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 5, 6] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert decontamination.benchmark_passages(docs_of(spark, texts), benchmark.limit(0)).count() == 0


def test_passages_at_the_edge_of_documents_are_found():
    item = " ".join(words(80, 9))
    index = decontamination.Index.of([(1, item)])
    for k in range(0, 400, 3):  # the document before ends with the passage's first characters
        got = decontamination.passages(["x" * k + item[:20], item + " after"], index)
        assert [len(found) for found in got] == [0, 1] and got[1][0][1:] == (0, len(item), 0)


def least_edits(pattern, text):
    """Sellers' table: the least edits of ``pattern`` to any part of ``text``."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        same = row[:-1] + np.array([c != d for d in text], int) if text else row[:0]
        best = np.minimum(same, row[1:] + 1)
        for j in range(1, len(row)):
            new[j] = min(best[j - 1], new[j - 1] + 1)
        row = new
    return int(row.min())


def test_decontamination_equals_brute_force(spark):
    r = random.Random(6)
    items = [" ".join(words(k, 40 + k, 60)) for k in (2, 3, 6, 12, 20)] + ["ab" * 30, "What?", "x y", "=" * 40, " ", "W"]
    docs = [None, "", "abc What? xyz", "abcWhat?", "so x  Y it is", "W", "aW b", "=" * 45]
    for k in range(80):
        passage = list(items[k % 6])
        for _ in range(r.randrange(6)):
            at = r.randrange(len(passage))
            passage[at : at + r.randrange(2)] = r.choice(["", "q", "zz"])
        docs.append(" ".join(words(r.randrange(12), k, 60)) + " " + "".join(passage) + " " + " ".join(words(r.randrange(12), 900 + k, 60)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.benchmark_passages(docs_of(spark, docs), benchmark).collect()}
    expected = set()
    for d, text in enumerate(docs):
        low = " ".join((text or "").lower().split())
        for i, item in enumerate(items):
            m = item.lower().strip()
            if 0 < len(m) < decontamination.Q:
                if re.search(rf"(?<![a-z0-9]){re.escape(m)}(?![a-z0-9])" if m[-1].isalnum() else rf"(?<![a-z0-9]){re.escape(m)}", low):
                    expected.add((d, i))
            elif m and least_edits(m, low) <= decontamination.budget(len(m)):
                expected.add((d, i))
    assert got == expected and len(expected) > 40
    nulls = spark.createDataFrame([(None, items[3], 1), (1, items[3], 2), (1, items[3], 3)], "doc_id long, text string, item_id int")
    assert sorted((x.doc_id or 0, x.item_id) for x in decontamination.benchmark_passages(nulls, benchmark).where("item_id = 3").collect()) == [(0, 3), (1, 3), (1, 3)]
    assert decontamination.without_passages(nulls.limit(0), benchmark).count() == 0 == decontamination.without_passages(nulls, benchmark).count()


def test_repetitive_texts_take_linear_time():
    index = decontamination.Index.of([(1, "=" * 1000), (2, "ab" * 400)])
    began = time.time()
    found = decontamination.passages(["=" * 1_000_000, "ab" * 300_000 + "x", "=" * 999], index)
    assert {f[0] for f in found[0]} == {0} and {f[0] for f in found[1]} == {1} and time.time() - began < 60


# ------------------------------------------------------------------ 6


def page(article, extra=""):
    return f"<html><head><title>T</title><script>x('</p>')</script></head><body><nav><ul><li>Menu</ul></nav>{extra}{article}<footer>F &copy;</footer>"


def test_html(spark):
    rows = [
        (1, "http://a.example/y/1", page("<article><h1>A &amp; B</h1><p><b>one<br><p>two \n three</article>")),
        (2, "http://a.example/x/2", page("<div>Site line</div><div>Own text</div>")),
        (3, "http://a.example/x/3", page("<div>Site line</div><div>Other text</div>", '<div class="ad">buy</div>')),
        (4, None, None), (5, "http://b.example/", ""), (5, "http://b.example/", ""),
        (6, "http://c.example/", page("<article>Shared</article>")), (7, "http://c.example/1", page("<article>Shared</article>")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shared", F.lit(1))
    got = sorted((r.page_id, r.text) for r in html_extraction.extract_text(pages).collect())
    assert got == [(1, "A & B\none\ntwo three"), (2, "Own text"), (3, "Other text"), (4, ""), (5, ""), (5, ""), (6, "Shared"), (7, "Shared")]
    assert html_extraction.extract_text(pages.limit(0)).count() == 0


def test_differencing_judges_what_is_the_article(spark):
    """Without a neighbour the mark alone decides; with one, template boxes go and a mark beside the page's own text is overruled."""
    teaser = "<main>Teaser</main><div>{}</div>"
    article = "<article><p>Common line</p><div>Read our <b>letter</b></div><p>Own {}</p><div>Box {} of its own</div><ul><li>Follow us</ul></article>"
    rows = [(k, f"http://h.example/a/{k}", page(article.format(k, k))) for k in range(3)] + [(10 + k, f"http://t.example/{k}", page(teaser.format(f"The text that number {k} is about"))) for k in range(2)]
    rows += [(20, "http://alone.example/a", page(article.format(0, 0))), (21, "http://copy.example/1", page(article.format(1, 1))), (22, "http://copy.example/2", page(article.format(1, 1)))]
    got = {r.page_id: r.text for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Common line\nRead our letter\nOwn {0}\nBox {0} of its own\nFollow us"
    assert got == {k: f"Common line\nOwn {k}\nBox {k} of its own" for k in range(3)} | {10 + k: f"The text that number {k} is about" for k in range(2)} | {20: whole.format(0), 21: whole.format(1), 22: whole.format(1)}


def test_extraction_equals_its_definition(spark):
    """Pages of random lines in random places, against a plain reading of the same rules from the lines that made them."""
    r = random.Random(4)
    pool = [f"site line {k}" for k in range(6)]
    made = {}
    for k in range(60):
        parts = [(place, r.choice([*pool, f"own {k} {i}"])) for i, place in enumerate(sorted(r.choice("cdm") for _ in range(r.randrange(8))))]
        made[f"http://r{k % 4}.example/p/{k:03}"] = parts
    wrap = {"c": "<nav>{}</nav>", "d": "<div>{}</div>", "m": "<p>{}</p>"}
    source = lambda parts: "".join(wrap[p].format(t) for p, t in parts if p != "m") + ("<article>" + "".join(wrap[p].format(t) for p, t in parts if p == "m") + "</article>" if any(p == "m" for p, _ in parts) else "")
    rows = [(k, url, source(parts)) for k, (url, parts) in enumerate(made.items())]
    got = {x.url: x.text for x in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    for url, parts in made.items():
        host = sorted(u for u in made if u.split("/")[2] == url.split("/")[2])
        at = host.index(url)
        near = [u for u in (host[at - 1] if at else None, host[at + 1] if at + 1 < len(host) else None) if u]
        best = max(near, key=lambda u: len(os.path.commonprefix([u, url])))
        common = html_extraction.common_lines([hash(t) for _, t in parts], [hash(t) for _, t in made[best]])
        own = [(p, t) for i, (p, t) in enumerate(parts) if p != "c" and i not in common]
        marked = [t for p, t in parts if p == "m"]
        outside = sum(len(t) for p, t in own if p == "d")
        assert got[url] == "\n".join([t for _, t in own] if not marked or outside > sum(map(len, marked)) else marked), url


def test_long_pages_take_linear_time():
    began = time.time()
    assert len(html_blocks.blocks("<p>a" * 200_000)) == 200_000
    assert html_blocks.blocks("<div>" * 100_000 + "</b>" * 100_000 + "x")[0].text == "x"
    same = [1] * 20_000
    assert len(html_extraction.common_lines(same, [2, *same])) == 20_000
    r = random.Random(1)
    mixed = [[r.randrange(3) for _ in range(20_000)] for _ in range(2)]
    assert len(html_extraction.common_lines(*mixed)) > 12_000 and time.time() - began < 60


def test_common_lines_is_longest(monkeypatch):
    r = random.Random(2)
    for k in range(200):
        monkeypatch.setattr(html_extraction, "ROWS_BYTES", 1 if k % 2 else 1 << 20)
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        found = [a[i] for i in html_extraction.common_lines(a, b)]
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(x in rest for x in found)


def test_blocks_of_broken_markup():
    assert [b.text for b in html_blocks.blocks("a<p>b<!-- c <p>d")] == ["a", "b"]
    assert [b.text for b in html_blocks.blocks("<p title='x>y'>t</p>&lt;z&am")] == ["t", "<z&am"]


def test_articles_keep_what_only_sounds_like_a_menu():
    kept = '<div class="entry-header"><h1>A</h1></div><h2 id="related-work">B</h2><section id="search-results-explained">C</section><p class="notice-of-meeting">D</p><p class="notice">E</p>'
    dropped = '<div class="share">x</div><div class="box related">x</div><aside>x</aside><nav>x</nav>'
    assert [b.text for b in html_blocks.blocks(f"<article>{kept}{dropped}</article>") if b.place == html_blocks.MAIN] == list("ABCDE")
    assert all(b.place == html_blocks.DROPPED for b in html_blocks.blocks('<div class="page-header">x</div><p class="cookie-notice">x</p>'))


# ------------------------------------------------------------------ 7


def test_urls(spark):
    urls = ["https://A.example.ORG/es/1?x", "http://example.org/en/12", "http://x.com/fr/", "http://x.com/de/#a", "http://y.org", None, "no scheme", "http://com/fr/1"]
    urls += [f"http://spam-{k}.net/buy/{k}" for k in range(5)]
    labelled = spark.createDataFrame([(f"http://spam-{k}.net/buy/{k}", "block") for k in range(20)] + [(f"http://good{k}.net/read/{k}", "allow") for k in range(20)], "url string, verdict string")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df, labelled=labelled).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(4)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert [(got[i].host, got[i].path, got[i].rule) for i in (4, 5, 6, 7)] == [("y.org", "", None), ("", "", None), ("", "", None), ("com", "/fr/1", "com/fr/")]
    assert all(got[i].verdict == "block" for i in range(8, 13)) and got[0].host == "a.example.org"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_rules_are_all_mined_and_matched(spark, monkeypatch):
    long = "/".join(f"s{i}" for i in range(30))  # would have 2**30 token sets if its parts were mined one by one
    rows = [(f"http://h{k % 9}.net/{long}/end?{'&'.join(f'q{i}=1' for i in range(8))}", "block") for k in range(90)]
    rows += [(f"http://g{k}.net/shop/x{k}", "allow" if k % 10 else "block") for k in range(100)]
    mined = url_filter.mine(spark.createDataFrame(rows, "url string, verdict string")).collect()
    found = {(tuple(sorted(r.antecedent)), r.verdict): round(r.confidence, 3) for r in mined}
    assert found[("path0=shop",), "allow"] == 0.9 and found[("path29=s0",), "block"] == found[("query=q7",), "block"] == found[("path30=end",), "block"] == 1
    monkeypatch.setattr(url_filter, "BLOCK_RULES", 3)
    rules = spark.createDataFrame([([f"path0={chr(97 + k)}"], "block" if k % 2 else "allow", 1 - k / 100, 0.1) for k in range(10)], "antecedent array<string>, verdict string, confidence double, share double")
    urls = spark.createDataFrame([(f"http://a.b/{chr(97 + k)}",) for k in range(11)], "url string")
    got = [r.mined for r in url_filter.match(urls.coalesce(1), rules).collect()]
    assert got == [*["allow", "block"] * 5, None]


def test_url_rules_equal_brute_force(spark, monkeypatch):
    """All token sets of all labelled URLs, counted one by one; each URL's verdict is that of its best rule."""
    from itertools import combinations

    r = random.Random(12)
    url = lambda: f"http://{r.choice('ab')}.{r.choice(['net', 'org'])}/{r.choice('xyz')}{'/' + r.choice('uv') if r.random() < 0.6 else ''}{'?q=1' if r.random() < 0.4 else ''}"
    urls = [url() for _ in range(150)]
    rows = [(u, "block" if ("/x" in u) != (r.random() < 0.25) else "allow") for u in urls]
    split = {x.url: x.t for x in spark.createDataFrame([(u,) for u in {*urls}], "url string").select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    counts, both = {}, {}
    for u, verdict in rows:
        t = sorted(split[u])
        for k in range(1, len(t) + 1):
            for part in combinations(t, k):
                counts[part] = counts.get(part, 0) + 1
                both[part, verdict] = both.get((part, verdict), 0) + 1
    share = {x: n / len(rows) for x, n in both.items() if n / len(rows) >= 0.05}
    confidence = {(p, v): both[p, v] / counts[p] for p, v in share}
    kept = {(p, v) for p, v in share if confidence[p, v] >= 0.7 and not any(confidence.get((q, v), 0) >= confidence[p, v] for k in range(1, len(p)) for q in combinations(p, k))}
    mined = url_filter.mine(spark.createDataFrame(rows, "url string, verdict string"), 0.05, 0.7)
    found = {(tuple(sorted(x.antecedent)), x.verdict): (round(x.confidence, 9), round(x.share, 9)) for x in mined.collect()}
    # tokens of the same URLs are one when mined, so that a rule with two of them is not
    assert set(found) == kept and all(found[x] == (round(confidence[x], 9), round(share[x], 9)) for x in kept) and len(kept) > 5
    got = {x.url: x.mined for x in url_filter.match(spark.createDataFrame([(u,) for u in {*urls}], "url string"), mined).collect()}
    for u in {*urls}:
        fits = [(-confidence[x], -share[x], x[1] != "block") for x in kept if set(x[0]) <= set(split[u])]
        assert got[u] == (None if not fits else "allow" if min(fits)[2] else "block")


# ------------------------------------------------------------------ 8


def test_media(spark):
    texts = [None, "", "x" * 576, "RIFF and GIF89a and \x89PNG", "é" * 1000, "é" * 1000]
    rows = {r.doc_id: r for r in media_sniffing.sniff_media(media_sniffing.store_texts(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        wanted = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert rows[i].samples == wanted and rows[i].true_type == "audio/wav" and rows[i].n_bytes == len(raw)
    assert (rows[4].media, rows[4].declared_type) == (rows[5].media, rows[5].declared_type)


def test_carving(spark):
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")
    wav = media_sniffing.as_wav(b"samples!" + png + b"...")
    df = spark.createDataFrame([(wav, "image/png"), (png[:-1], "image/png"), (None, None), (b"", "a")], "media binary, declared_type string")
    a, b, c, d = media_sniffing.sniff_media(df.coalesce(1)).collect()
    assert (a.true_type, a.corrected, a.embedded[0].bytes, a.embedded[0].type) == ("audio/wav", True, bytearray(png), "image/png")
    assert (b.true_type, b.corrected, b.signatures, b.embedded) == ("image/png", False, 1, []) and c.signatures == d.signatures == 0


def test_media_query_equals_reading_the_files(spark, tmp_path):
    """Each digest column from the stored bytes, as the standard library reads them."""
    import io
    import wave

    texts = [None, "", "abc", "é" * 700, "RIFF%PDF-1 GIF89a", "x" * 576, "same", "same"]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = {r.doc_id: bytes(r.media) for r in media_sniffing.store_texts(docs).collect()}
    for r in media_sniffing.query(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        with wave.open(io.BytesIO(stored[r.doc_id])) as file:
            assert file.getsampwidth() == 1 and file.readframes(file.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        level = [b - 128 for b in payload]
        assert f"rms={math.sqrt(sum(v * v for v in level) / len(level)):.4f};crossings={sum((a < 0) != (b < 0) for a, b in zip(level, level[1:]))};peak={max(map(abs, level))}" in r.feature


def test_many_signatures_take_linear_time(spark):
    began = time.time()
    media = [b"%PDF-1" * 150_000 + b"startxref%%EOF", b"%PDF-1" * 150_000, b"PK\x03\x04" * 200_000 + b"PK\x05\x06"]
    rows = media_sniffing.sniff_media(spark.createDataFrame([(m, None) for m in media], "media binary, declared_type string").coalesce(1)).collect()
    assert rows[0].true_type == "application/pdf" and sum(bool(e.bytes) for e in rows[0].embedded) == 1 and time.time() - began < 60
    assert media_sniffing.sniff_media(spark.createDataFrame([], "media binary, declared_type string")).count() == 0


# ------------------------------------------------------------------ 9

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "email":
            return True
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            s = sum(x - 9 if x > 9 else x for i, c in enumerate(reversed(d)) for x in [int(c) * (1 + i % 2)])
            return 16 <= len(d) <= 19 and s % 10 == 0
        return 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_pii(spark):
    r = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f.g x@y", "é 4111 1111-1111 1111, 1.2.3.4.5.6.7.8 0001.2.3.256", "+1 (274) 555-9629 and +1-2", "1 " * 9000, "a.b@" * 3000, "4111111111111111", "1.2.3.000000000000000000001"]
    texts += ["".join(r.choice("0123456789 .-+()@ab") for _ in range(r.randrange(200))) for _ in range(200)]
    found = pii_disclosure.personal_spans(docs_of(spark, texts)).collect()
    for row in found:
        assert [tuple(b) for b in row.base] == brute_spans(texts[row.doc_id]), texts[row.doc_id]
    hidden = {row.doc_id: row.text for row in pii_disclosure.sanitised(pii_disclosure.personal_spans(docs_of(spark, texts))).collect()}
    assert hidden[4] == "[PHONE] and +1-2" and hidden[0] is None
    assert pii_disclosure.personal_spans(docs_of(spark, texts).limit(0)).count() == 0


def test_digit_runs_take_linear_time(spark):
    texts = [c * n for n in (1000, 400_000) for c in ("1", "1.", "a", "a1", "1 ", "+1", "a.", "1-")] + ["1" * 400_000 + ".2", "x@" * 200_000]
    began = time.time()
    found = pii_disclosure.personal_spans(docs_of(spark, texts)).select("doc_id", F.size("base").alias("n")).collect()
    assert len(found) == len(texts) and time.time() - began < 60


def brute_disclosure(texts):
    """Spans of secrets and terms of every text, by the definition."""
    word, secret = regex.compile(pii_disclosure._TERM), re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}")
    terms, values = [{m.group().lower() for m in word.finditer(t or "")} for t in texts], []
    secrets = [[m.span() for m in secret.finditer(t or "") if len(re.findall("[0-9]", m.group())) >= 4 and re.search("[A-Za-z]", m.group())] for t in texts]
    for t, found in zip(texts, secrets, strict=True):
        base = [(k, (t or "")[a:b].lower() if k == "email" else re.sub("[^0-9]", "", (t or "")[a:b]) if k != "ip" else (t or "")[a:b]) for k, a, b in brute_spans(t)]
        values.append({*base, *(("secret", t[a:b]) for a, b in found)})
    up = {v: v for vs in values for v in vs}
    root = lambda v: v if up[v] == v else root(up[v])
    for vs in values:
        for v in vs:
            up[root(v)] = root(min(vs))
    entities = {}
    for i, vs in enumerate(values):
        for e in {root(v) for v in vs} | {k for k, _ in vs}:
            entities.setdefault(e, set()).add(i)
    of, everywhere = {}, set()
    for e, docs in entities.items():
        for term in set().union(*(terms[i] for i in docs)):
            both = [i for i in docs if term in terms[i]]
            n_t, ic = sum(term in x for x in terms), math.log2(len(texts) / len(docs))
            pmi = math.log2(len(both) * len(texts) / (len(docs) * n_t))
            share = pii_disclosure.OF_PERSON if isinstance(e, tuple) else pii_disclosure.OF_KIND
            if len({texts[i] for i in both}) >= pii_disclosure.SUPPORT and ic > 0 and pmi / ic >= pii_disclosure.GENERALISE and len(both) >= share * len(docs):
                remove = pmi / ic >= pii_disclosure.REMOVE
                everywhere |= {term} if remove and isinstance(e, tuple) else set()
                for i in docs:
                    of.setdefault((i, term), set()).add(remove)
    out = []
    for i, t in enumerate(texts):
        taken = [(a, b) for _, a, b in brute_spans(t)] + secrets[i]
        found = [(m.start(), m.end(), "remove" if True in of.get((i, m.group().lower()), ()) or m.group().lower() in everywhere else "generalise") for m in word.finditer(t or "") if (i, m.group().lower()) in of or m.group().lower() in everywhere]
        out.append((secrets[i], [x for x in found if not any(a < x[1] and x[0] < b for a, b in taken)]))
    return out


def test_disclosing_terms_equal_brute_force(spark):
    """Persons with several values, terms far from them and in other texts, copies of one text, chance words, a kind's own word."""
    r = random.Random(8)
    filler = lambda n: " ".join(f"word{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(n))
    texts = [f"Kowalczyk said {filler(40)} to Bo write to someone@x.org {filler(60)} or ask Kowalczyk and Bo" for _ in range(3)]
    texts += [f"{filler(30)} call +1 (274) 555-9629 or someone@x.org said Kowalczyk of Bo" for _ in range(3)]
    texts += [f"{filler(20)} call +1 (274) 555-9629, {filler(30)} Bo" for _ in range(2)] + [f"copied {filler(20)} me@copy.org"] * 8
    texts += [f'{filler(20)} apikey = "{hashlib.sha1(str(k).encode()).hexdigest()}" {filler(5)}' for k in range(12)]
    texts += [filler(30) for _ in range(560)] + ["a Kowalczyk came", "and Bo", "a apikey", None, "", "é 你好 Bo", "she said"]
    expected = brute_disclosure(texts)
    rows = {r.doc_id: ([(x.start, x.end) for x in r.secrets], [(t.start, t.end, t.action) for t in r.terms]) for r in pii_disclosure.personal_spans(docs_of(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == expected
    shown = {texts[i][a:b] for i, (_, found) in enumerate(expected) for a, b, _ in found}
    assert {"Kowalczyk", "Bo", "apikey"} <= shown and "copied" not in shown and expected[-1][1]


@pytest.mark.parametrize("others", [120, 1200])
def test_planted_terms_are_found_at_every_size(spark, others):
    """Twenty persons in three documents each, with one term of their own, in a small and a large corpus; of other words none is hidden."""
    r = random.Random(others)
    filler = lambda n: " ".join(f"common{chr(97 + r.randrange(26))}" for _ in range(n))
    name = lambda k: f"Planted{chr(97 + k)}"
    texts = [f"{filler(20)} {name(k)} {filler(9)} p{k}@home.org {filler(i)}" for k in range(20) for i in range(3)] + [filler(30) for _ in range(others)]
    rows = {row.doc_id: row.terms for row in pii_disclosure.personal_spans(docs_of(spark, texts)).collect()}
    hidden = {texts[i][t.start : t.end] for i, terms in rows.items() for t in terms}
    planted = {name(k) for k in range(20)}
    assert planted <= hidden and hidden - planted <= {"home"}
    assert all(any(texts[i][t.start : t.end] == name(i // 3) for t in rows[i]) for i in range(60))


# ------------------------------------------------------------------ 10


def test_quality_is_learnt(spark):
    r = random.Random(4)
    good = [" ".join(words(60, k)) for k in range(200)]
    bad = [" ".join(w for w in words(10, k) for _ in range(6)) for k in range(100)]
    texts = [None, ""] + good + bad
    labels = spark.createDataFrame([(i, int(i < 202), 0) for i in range(2, 302)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    model = quality_classifier.train(docs, labels)
    scores = {row.doc_id: row.score for row in quality_classifier.score_documents(docs, model).collect()}
    held = [i for i in range(2, 302) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scores[i] >= quality_classifier.ACCEPT) == (i < 202) for i in held)
    assert right >= 0.9 * len(held) and scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())
    assert quality_classifier.score_documents(docs.limit(0), quality_classifier.train(docs.limit(0), labels)).count() == 0
    del r


def test_ftrl_equals_its_plain_form():
    """Coordinate by coordinate, over counted words and pairs of words in dictionaries."""
    r = random.Random(21)
    texts = [" ".join(r.choice(["good", "bad", "word", "more,", "x1"]) for _ in range(r.randrange(1, 12))) for _ in range(40)]
    labels = [int("good" in t) for t in texts]
    row, slot, value = quality_classifier.features([t.encode() for t in texts])
    plain = []
    for t in texts:
        tokens = re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]+", t)
        shown = ["<repeat>" if i and tokens[i - 1] == w else w for i, w in enumerate(tokens)]
        counted = {}
        for gram in [*((w,) for w in shown), *zip(shown, shown[1:])]:
            counted[gram] = counted.get(gram, 0) + 1
        plain.append(sorted(1 + math.log(n) for n in counted.values()))
    for k, values in enumerate(plain):
        norm = math.sqrt(sum(v * v for v in values))
        assert np.allclose(sorted(value[row == k]), [v / norm for v in values])
    rows = [(slot[row == k], value[row == k]) for k in range(len(texts))]
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / (1 + math.sqrt(n[i]) + 0.02)
    rng = np.random.default_rng(7)
    for _ in range(3):
        for k in rng.permutation(len(rows)):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True)), "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[k]) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) * w[i]
                n[i] = n.get(i, 0.0) + g * g
    model = quality_classifier.fit(rows, labels, epochs=3)
    assert abs(model.bias - weight("bias")) < 1e-9
    assert all(abs(model.weights[i] - weight(i)) < 1e-6 for i in z if i != "bias") and np.count_nonzero(model.weights) <= len(z)


# ------------------------------------------------------------------ the pipeline


def test_pipeline_equals_its_stages_by_hand(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, None
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir).cache()
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(kept) <= set(before)
        if name == "near_duplicates":
            ids = sorted(before)
            assert set(kept) == {ids[c] for _, c in brute_components([before[i] for i in ids]).values()}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(kept) == {i for i, t in before.items() if not any(x in t for x in items)}
        if name == "pii":
            assert not any(brute_spans(t) for t in kept.values())
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_pipeline_with_odd_rows(spark):
    """Nulls in every column, repeats, no rows, one more column and one column less."""
    from hexloom.llm.pii_disclosure import pii_stage

    pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    text = "The people of the town came to read what was written in the old book. Mail me@x.org now."
    rows = [(1, text, "en", "s", 90, 1), (1, text, "en", "s", 90, 1), (None, None, None, None, None, None), (2, "", "en", None, 0, 2), (3, text.replace("Mail", "Write to"), None, "s", None, 3), (None, text + " More.", "en", "s", 9, 4)]
    docs = spark.createDataFrame(rows, DOC + ", base int")
    for table in (docs, docs.limit(0), docs.drop("source")):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns and out.count() <= table.count()
        assert pipeline.STAGES[-1][1](spark, table, sf_dir).count() >= 0
    hidden = pii_stage(spark, docs.drop("n_chars"), sf_dir).where("doc_id = 1").collect()
    assert len(hidden) == 2 and all("[EMAIL]" in r.text for r in hidden)


