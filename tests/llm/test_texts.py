"""Operators on texts, pages and conversations against libraries, brute force and round trips."""

import base64
import collections
import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from rankloom.llm import bpe, chat, html, license, queries, tokens, toxicity

from ..oracle import SF
from .conftest import multiset

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(open(RANKS, "rb").read())


@pytest.mark.parametrize("block_bytes", [bpe.BLOCK_BYTES, 300])
def test_bpe_equals_the_library_and_round_trips(awkward, awkward_rows, nothing, ranks, block_bytes):
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    assert ranks == known
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    want = []
    for row in awkward_rows:
        ids = library.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((row[1] or "").encode())))
    encoded = bpe.encode(awkward, ranks, public_tokenizers.PATTERN, block_bytes)
    assert multiset(map(tuple, bpe.digest(bpe.decode(encoded, ranks)).collect())) == multiset(want)
    both = bpe.encode_decode(awkward, ranks, public_tokenizers.PATTERN, block_bytes)
    assert multiset(map(tuple, bpe.digest(both).collect())) == multiset(want)
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


# Token counts


def test_bpe_tells_blocks_of_equal_shape_apart(spark, ranks):
    # One-word texts under a null and a repeated doc_id, each in a block of its own.
    rows = [(None, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)] + [(7, f"v{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, 1).collect()
    assert multiset((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == multiset(rows)


def test_token_counts_equal_the_library(awkward, awkward_rows, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = open(PIECES, "rb").read()
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > tokens.LIMIT) for r in awkward_rows]
    assert multiset(map(tuple, tokens.count_tokens(awkward, model).collect())) == multiset(want)
    assert tokens.count_tokens(nothing, model).count() == 0


def test_merging_random_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = tokens.Counter(tokens.PieceModel(open(PIECES, "rb").read()))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefe  \n\té▁😀<s>ﬁ中文\x00") for _ in range(rng.randrange(80))) for _ in range(2000)] + ["a" * 5000, " " * 99, "</s><unk> <0x0A>", "▁▁ ▁"]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts, num_threads=1)]
    whole = tokens.PieceModel(open(PIECES, "rb").read())
    whole.cut = None
    assert [tokens.Counter(whole).count(t) for t in texts[:300]] == [counter.count(t) for t in texts[:300]]


# Chat


def test_chat_reads_back(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (2, 0, None, "x"), (3, 5, "assistant", "<\\|a|> <|"), (3, 1, "sys\ntem\\n", "b"), (4, 0, "assistant", ""), (None, 0, "assistant", "n"), (5, 0, "user", "t"), (5, 0, "user", "t"), (5, 0, "assistant", " é😀")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, examples string")
    made = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    assert len(got) == 6
    for conv in got:
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for role, t in mine if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine).encode()), len(loss), sha(loss.encode()))
    each = made.collect()
    assert sum(r["conv_id"] == 1 for r in each) == 2 and sum(r["formatted_chars"] for r in got.values()) == sum(len(r["text"]) for r in each)
    assert chat.digest(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_streams_a_long_conversation(spark):
    n = 1200
    turns = spark.range(n).selectExpr("cast(null as long) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('w ', 20) text")
    made = chat.format_conversations(turns)
    r = chat.digest(made).collect()[0]
    assert r["n_turns"] == n and r["loss_chars"] == n // 2 * 40
    each = made.where("n_turns > 1190").collect()
    assert [e["n_turns"] for e in each] == [1192, 1194, 1196, 1198, 1200] and all(e["text"][e["loss_start"] : e["loss_end"]] == "w " * 20 for e in each)


@pytest.mark.parametrize("section_turns", [1, 2, 3, 256])
def test_chat_sections_change_nothing(spark, section_turns):
    """Against examples written one by one, over conversations whose turns are trained in all patterns of five."""
    rows = [(conv, turn, "assistant" if conv >> turn & 1 else "user", f"{conv}<|{turn}") for conv in range(32) for turn in range(5)]
    rows += [(None, i, "assistant" if i % 4 == 1 else "user", "é") for i in range(9)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), section_turns)
    want = set()
    for conv in {r[0] for r in rows}:
        text, example, mine = "", 0, [r for r in rows if r[0] == conv]
        for n, (_, _, role, said) in enumerate(mine, 1):
            body = said.replace("<|", "<\\|")
            start = len(text) + len(f"<|im_start|>{role}\n")
            text += f"<|im_start|>{role}\n{body}<|im_end|>\n"
            if role == "assistant":
                want.add((conv, example, text, start, start + len(body), n))
                example += 1
        if role != "assistant":
            want.add((conv, example, text, 0, 0, n))
    got = made.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    said = {r["conv_id"]: r for r in chat.digest(made).collect()}
    assert {tuple(r) for r in chat.digest(made.orderBy(F.rand(3))).collect()} == {tuple(r) for r in said.values()}
    for conv, r in said.items():
        mine = [x for x in rows if x[0] == conv]
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for _, _, a, b in mine).encode())
        assert r["loss_sha256"] == sha("".join(b for _, _, a, b in mine if a == "assistant").encode())
        assert r["formatted_chars"] == sum(len(w[2]) for w in want if w[0] == conv)


def test_chat_deals_a_long_conversation_out(spark):
    turns = spark.range(4000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'w' text")
    per_task = chat.format_conversations(turns, 50).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 4 and sum(r["count"] for r in per_task) == 2000


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|x", "a<|im_end|>\n<|im_start|>", "\\<|\\", "<<|>|"])
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


# HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<title>t</title><p>a<p>b", "a\n\nb"),
        ("<p>Hello <b>big\n world</b>!<br>next", "Hello big world!\nnext"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><td>name<td>n<tr><td>longer<td>12</table>", "name    n\nlonger  12"),
        ("<table><caption>C</caption><thead><tr><th>a<tbody><tr><td>b</table>", "C\na\nb"),
        ("<table><tr><td>x<td><table><tr><td>in<td>ner</table></table>", "x  in  ner"),
        ("<pre>\n a\n   b</pre>", " a\n   b"),
        ("a<script>var x = '</p>'; if (a<b) {}</script>b<style>p{}</style><!-- c > d -->c", "abc"),
        ("<div hidden>no</div><div style='display : none'>no</div><p style=\"visibility:hidden\">no<i style='visibility:visible'>yes</i></p>", "yes"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a</p>b <unclosed attr='x", "a\n\nb\n\nattr='x" if False else None),
        ("x < y &lt; z &nosuch; &#65;", "x < y < z &nosuch; A"),
        ("<blockquote>q</blockquote><dl><dt>t<dd>d</dl>", "  q\n\nt\n  d"),
        ("<textarea> a\n b</textarea>", " a\n b"),
    ],
)
def test_renders(page, text):
    made = html.page_text(page)
    if text is not None:
        assert made == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><svg><title>t</title><desc>d</desc><defs><text>no</text></defs><g><text>Sales</text><text>20<tspan>24</tspan></text></g></svg><p>b", "a\n\nSales\n2024\n\nb"),
        ("<svg><metadata>m</metadata><text style='display:none'>h</text><text>x</text></svg>", "x"),
        ("<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> hold", "Let x=2 hold"),
        ("<svg><title/><defs/><path d='M0 0'/><text>x</text></svg>y", "x\ny"),
        ("<svg><text>in</text></svg><div>out <annotation>kept</annotation></div>", "in\nout kept"),
    ],
)
def test_renders_svg_and_math(page, text):
    assert html.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
        ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>", "A  b\n   c\n   d"),
        ("<table><tr><th colspan=3 rowspan=2>H<td>1<tr><td>2<tr><td>x<td>y<td>z<td>3</table>", "H        1\n         2\nx  y  z  3"),
        ("<table><caption>Long caption</caption><tr><td>a<td>b</table>", "Long caption\na  b"),
        ("<table><tr><td colspan=x rowspan=-3>a<td colspan=0>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=9><li>a<li value=4>b<li>c</ol>", "9. a\n4. b\n3. c"),
        ("<ul><li value=7>a</ul>", "- a"),
        ("<form><input type=submit value='Send it'> <input value=typed><input type=hidden value=no><input type=checkbox value=no></form>", "Send it typed"),
    ],
)
def test_renders_spans_list_numbers_and_fields(page, text):
    assert html.page_text(page) == text


def test_tables_are_laid_out_as_a_grid():
    """Random tables: each text starts where its column does, found by filling a grid cell by cell."""
    rng = random.Random(8)
    for _ in range(150):
        rows = [[(rng.randrange(1, 4), rng.randrange(1, 4), rng.choice("abcdefgh") * rng.randrange(1, 6)) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for a, d, t in row) for row in rows) + "</table>"
        grid = {}
        for r, row in enumerate(rows):
            c = 0
            for a, d, t in row:
                while (r, c) in grid:
                    c += 1
                for i in range(r, r + d):
                    for j in range(c, c + a):
                        grid[i, j] = (r, c, t)
                c += a
        lines = html.page_text(page).split("\n")
        starts = {}
        for r, line in enumerate(lines):
            mine = sorted({v for (i, _), v in grid.items() if v[0] == r == i}, key=lambda v: v[1])
            assert [m.group() for m in re.finditer(r"\S+", line)] == [t for _, _, t in mine]
            for (_, c, _), m in zip(mine, re.finditer(r"\S+", line)):
                assert starts.setdefault(c, m.start()) == m.start()
        assert sorted(starts.values()) == [starts[c] for c in sorted(starts)]


def test_renders_deep_and_broken_pages():
    assert html.page_text("<div>" * 30_000 + "deep") == "deep"
    assert html.page_text("<ul><li>" * 3000 + "x").endswith("- x")
    for page in ("<table>" * 500 + "x", "<a href=\"" * 2000, "</p>" * 2000 + "x", "<td>x<tr>y</table></table>", "<!--", "<", "<b", "&", "<p" * 5000, "<script>x", "<b><p></b></p>x"):
        html.page_text(page)


def test_keeps_all_visible_words(spark):
    from html.parser import HTMLParser

    class Visible(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.off, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        parser = Visible()
        parser.feed(r["html"])
        parser.close()
        want = "".join(parser.out).split()
        have = [w for w in got[r["page_id"]].split() if w != "-"]
        assert "".join(want).replace("-", "") == "".join(have).replace("-", "")
    odd = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "x"), (None, "", "x")], "page_id long, html string, text string")
    assert multiset(map(tuple, html.extract(odd).collect())) == multiset([(1, "", 0), (1, "a", 1), (None, "", 0)])
    assert html.extract(odd.limit(0)).count() == 0


# Licences


def test_classifier_on_held_out_copies():
    w, heat = license.train()
    x, y = license._matrix(license.copies(9))
    p = license.softmax(x @ w / heat)
    assert (p.argmax(1) == y).mean() > 0.93 and (np.abs(w) > 0).mean() < 0.5
    sure = p.max(1) > 0.9
    assert (p.argmax(1) == y)[sure].mean() > 0.97


def test_scans_awkward_documents(spark, awkward, awkward_rows, nothing):
    found = license.scan(awkward)
    assert found.count() == len(awkward_rows) and license.scan(nothing).count() == 0
    mit = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files"
    rows = [(1, mit), (2, "My driving licence was lost in the public library."), (3, "Licensed under the Apache License, Version 2.0.\nx\nReleased under the MIT License."), (3, "x"), (4, "This work is licensed under the GNU General Public License, version 3.")]
    got = license.digest(license.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert multiset((r["doc_id"], r["families"]) for r in got) == multiset([(1, "MIT"), (2, ""), (3, "Apache-2.0,MIT"), (3, ""), (4, "GPL")])
    assert next(r["n_unknown"] for r in got if r["doc_id"] == 2) == 1


def slow_scan(text):
    """Families in units, and lines with cues with whether they are confirmed; shares the weights with the scan, and no code."""
    w, constant = license.model()
    place = {g: i for i, g in enumerate(license.VOCABULARY)}

    def bag(words):
        stop = license.STOP
        return {x for x in words if x not in stop} | {a + " " + b for a, b in zip(words, words[1:]) if not (a in stop and b in stop)}

    templates = [(f, bag(re.findall("[a-z0-9]+", t.lower()))) for f, t in license.TEMPLATES]

    def judge(words):
        got = bag(words)
        z = constant + sum((w[place[g]] for g in got if g in place), np.zeros(len(constant)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = max(range(len(z)), key=lambda c: (z[c], c))
        name = license.CLASSES[k]
        cover = max([len(got & t) / min(len(got), len(t)) for f, t in templates if f == name and got], default=0)
        return name if name != "unknown" and p[k] >= 0.5 and cover >= 0.5 else None

    units = re.split(r"\n[ \t\r]*\n", text)
    sentences = [x for u in units for x in re.split(r"(?<=[.!?;])[ \t\n\x0b\f\r]+", u)]
    clauses = [x for u in sentences for x in re.split(r"[,:()/|]+|\b(?:and|or)\b", u, flags=re.ASCII | re.IGNORECASE)]
    lines = text.split("\n")
    found = set()
    cut = lambda u: re.findall("[a-z0-9]+", u.lower())
    for u in {*units, *sentences, *lines}:
        if len(cut(u)) <= 60:
            found.add(judge(cut(u)))
    for u in set(clauses):
        x = cut(u)
        for i in range(0, max(1, len(x) - 30), 30) if len(x) > 60 else [0]:
            found.add(judge(x[i : i + 60]))
    cued = []
    for i, line in enumerate(lines):
        if re.search("licen[sc]e|copyright|warrant|redistribut|permission is hereby|creative commons|public domain", line, re.I):
            forms = [line, " ".join(lines[max(i - 1, 0) : i + 1]), " ".join(lines[i : i + 5])]
            cued.append(any(judge(cut(f)) for f in forms))
    return found - {None}, cued


def test_scan_equals_a_plain_scan(spark, awkward_rows):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, r[1]) for i, r in enumerate(awkward_rows)]
    rng = random.Random(4)
    filler = "the of and software public under version work free a in mit nd do".split()
    for i in range(150):  # notices in prose, some of them on several lines, cut or in a row
        words = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice(license.TEMPLATES)[1].split()
            words += rng.choices(filler, k=rng.randrange(0, 90)) + notice[: rng.randrange(2, len(notice) + 1)] + rng.choice([["and"], ["\n\n"], ["."], []])
        rows.append((20_000 + i, "".join(x + rng.choice(["\n", "  ", " ", " ", " "]) for x in words)))
    for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want, cued = slow_scan(dict(rows)[r["doc_id"]] or "")
        assert set(r["passages"]) == want and r["n_cues"] == len(cued)
        assert [n["family"] != license.UNKNOWN for n in r["notices"]] == cued


def test_unknown_class_on_real_documents(spark):
    """Documents without a notice stay without a family: a notice in the given tables is a line that starts with one of two words."""
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    got = license.digest(license.scan(docs.where("not text rlike '(?m)^(Licensed|Released|This work is licensed) '"))).collect()
    assert len(got) > 900 and not [r for r in got if r["families"]]


def test_every_notice_of_the_given_documents_is_identified(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet").where("text rlike '(?i)licensed under|released under'").select("doc_id", "text")
    got = license.digest(license.scan(docs)).collect()
    assert len(got) > 200 and sum(r["n_unknown"] for r in got) == 0
    assert sum("CC-BY-NC" in r["families"].split(",") for r in got) > 50


def test_wrapped_and_cueless_notices_and_two_on_a_line(spark):
    texts = {
        "Released under the MIT\nLicense.": "MIT",
        "Distributed under the BSD 3-Clause\nLicense.": "BSD",
        "Some prose.\n\nDistributed under GPL v3\n\nMore prose.": "GPL",
        "SPDX: Apache-2.0": "Apache-2.0",
        "Released under the MIT License. Licensed under CC BY-NC 4.0.": "CC-BY-NC,MIT",
        "Mit dem Zug. Mit. Er kam mit.": "",
        "version 2.0 of the work": "",
        "GNU Affero General Public License v3": "AGPL",
        "This library is under the GNU Lesser General Public License, version 2.1": "LGPL",
        "Licensed under GPLv3.": "GPL",
        "Dual licensed under the MIT License and the Apache License": "Apache-2.0,MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
        "CC BY 4.0": "CC-BY",
        "GNU GPL, version 2 or later": "GPL",
        "word " * 500 + "released under the MIT license " + "other " * 500: "MIT",
        "The software is free. The general public can use the library. Copyright law and the license.": "",
        "My driving licence was lost in the public library.": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in license.digest(license.scan(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_templates_and_short_forms_are_identified(spark):
    rows = [(i, t, f) for i, (f, t) in enumerate(license.TEMPLATES)]
    short = {"Licensed under CC BY-NC 3.0.": "CC-BY-NC", "Licensed under CC BY 3.0": "CC-BY", "Released under the ISC license": "ISC", "Licensed under CC0": "CC0", "This is free and unencumbered software released into the public domain.": "Unlicense"}
    rows += [(1000 + i, t, f) for i, (t, f) in enumerate(short.items())]
    got = {r["doc_id"]: r["families"] for r in license.digest(license.scan(spark.createDataFrame(rows, "doc_id long, text string, family string"))).collect()}
    missed = [(t, f, got[i]) for i, t, f in rows if f not in got[i].split(",")]
    assert not missed
    others = [(t, f, got[i]) for i, t, f in rows if got[i] != f]
    assert len(others) <= 0.05 * len(rows), others  # clauses that two licences share


# Toxicity


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        words = rng.choices(plain, k=rng.randrange(5, 60)) + (rng.choices(["blorg", "snark", "grumf"], k=4) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_held_out_accuracy(insults):
    docs, labels = insults
    index = toxicity.fit(docs, labels)
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.score(docs, index).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["evidence"] for r in got)


def slow_neighbours(texts, labels, k):
    """From the raw texts alone: for each text, the k labelled texts of largest TF-IDF cosine as (doc_id, cosine)."""
    import math
    import zlib

    def counts(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        return collections.Counter(w[:4] for w in words)

    bags = [counts(t) for _, t in texts]
    df = collections.Counter(t for b in bags for t in b)
    once, examples = set(), []
    for (d, t), b in sorted(zip(texts, bags), key=lambda x: (x[0][0], x[0][1] or "")):
        if d in labels and zlib.crc32(str(d).encode()) % 5 and t not in once and d not in [e[0] for e in examples]:
            once.add(t)
            examples.append((d, b))
    space = {t for _, b in examples for t in b}
    idf = {t: math.log((1 + 1 / (df[t] / len(texts) + 0.01)) / 2) + 0.02 for t in space}

    def unit(bag):
        v = {t: n * idf[t] for t, n in bag.items() if t in space}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    space_of = [(d, unit(b)) for d, b in examples]
    out = []
    for bag in bags:
        q = unit(bag)
        near = [(d, sum(x * v[t] for t, x in q.items() if t in v)) for d, v in space_of]
        out.append(sorted(((d, c) for d, c in near if c > 1e-12), key=lambda x: (-round(x[1], 6), x[0]))[:k])
    return out


@pytest.mark.parametrize("k, common", [(40, toxicity.COMMON), (3, 10**6), (900, 1), (7, 4)])
def test_search_equals_brute_force_from_raw_texts(spark, insults, awkward_rows, monkeypatch, k, common):
    monkeypatch.setattr(toxicity, "COMMON", common)  # all lists by block, none, and some
    docs, labels = insults
    texts = [(r["doc_id"], r["text"]) for r in docs.limit(300).collect()] + [(10_000 + i, x[1]) for i, x in enumerate(awkward_rows)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    index = toxicity.fit(table, labels)
    want = slow_neighbours(texts, {r["doc_id"] for r in labels.collect()}, k)
    for (_, text), near, (best, cosine) in zip(texts, want, index.nearest([t for _, t in texts], k)):
        assert len(best) == len(near) == len(set(best.tolist()))
        assert np.allclose(cosine, [c for _, c in near], atol=1e-6)
        edge = near[-1][1] if near else 0
        assert {index.ids[b] for b, c in zip(best, cosine) if c > edge + 1e-6} == {d for d, c in near if c > edge + 1e-6}


def test_every_text_with_words_has_a_whole_vector(insults):
    docs, labels = insults
    index = toxicity.fit(docs, labels)
    for r in docs.collect():
        owner, term, q = index.vectors([r["text"]])
        assert len(term) == len(set(toxicity.stems(r["text"]))) > 0 and np.isclose(q @ q, 1)


def test_recall_and_calibration_on_given_labels(spark):
    """All labels of the larger table; figures of the README."""
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    index = toxicity.fit(docs, labels)
    held = docs.where(toxicity.held_out(docs.doc_id)).join(labels.select("doc_id", "toxic"), "doc_id").dropDuplicates(["doc_id"])
    got = toxicity.score(held, index).join(labels.select("doc_id", "toxic"), "doc_id").toPandas().drop_duplicates("doc_id")
    toxic, said = got.toxic == 1, got.predicted == 1
    recall, precision = (said & toxic).sum() / toxic.sum(), (said & toxic).sum() / said.sum()
    expected = got.score.mean() / toxic.mean()
    print(f"recall {recall:.3f} precision {precision:.3f} mean score by share of toxic {expected:.3f}")
    assert recall > 0.75 and precision > 0.9 and 0.7 < expected < 1.4
    assert got.evidence.map(len).gt(0).mean() > 0.95


def test_scores_ignore_held_out_labels(insults):
    from pyspark.sql import functions as F

    docs, labels = insults
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (multiset(map(tuple, toxicity.digest(toxicity.score(docs, toxicity.fit(docs, x))).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_of_awkward_documents(spark, awkward, awkward_rows, nothing, insults):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(awkward, toxicity.fit(awkward, labels)).collect()
    assert len(got) == len(awkward_rows) and all(0 <= r["score"] <= 1 for r in got)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(awkward, toxicity.fit(awkward, some)).count() == len(awkward_rows)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


# All queries, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_their_columns(spark, name):
    columns = {
        "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op2": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op4": "doc_id fingerprint component_id",
        "op5": "doc_id held_out score predicted",
        "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op9": "doc_id n_bytes n_tokens over_limit",
        "op10": "doc_id n_words n_removed kept_sha256",
    }
    made = queries.queries()[name](spark, SF)
    want = columns.get(name.split("_")[0], "").split()
    assert made.columns[: len(want)] == want and made.count() > 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    from .test_documents import hits, judged, slow_components, slow_fingerprint, slow_removal, SPACED

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if not judged(r[1])[5]]
    found, _ = slow_components([r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows])
    rows = [r for r, f in zip(rows, found) if f[0] == f[2]]
    removal = {d: (gone, kept) for d, _, gone, kept in slow_removal(rows)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == {r[0] for r in rows}
    for d, text in rows:
        gone, kept = removal[d]
        assert got[d] == text if not gone else sha(" ".join(SPACED.findall(got[d])).encode()) == kept
    clean = {h[0] for h in hits(list(got.items()), items) if not h[5]}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == clean
    assert all(r["decoded_sha256"] == sha(got[r["doc_id"]].encode()) for r in out)


def test_pipeline_as_a_chain_of_awkward_rows(spark, awkward, awkward_rows, nothing, tmp_path):
    """Nulls, repeated rows and clashing columns through all stages, and an empty table."""
    import collections as c

    import corpus_pipeline

    from .test_documents import SPACED, hits, judged, slow_components, slow_fingerprint, slow_removal

    items = [(1, awkward_rows[22][1]), (None, "x y z x y z x y z x"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    awkward.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    rows = [x[:2] for x in awkward_rows if not judged(x[1])[5]]
    groups = c.defaultdict(list)
    fps = [slow_fingerprint(x[1]) for x in rows]
    names, _ = slow_components(list(range(len(rows))), fps)
    for x, (_, _, group) in zip(rows, names):
        groups[group].append(x)
    rows = []
    for mine in groups.values():  # of rows with the least doc_id any one may stay
        least = min((x[0] for x in mine if x[0] is not None), default=None)
        rows.append([x for x in mine if x[0] == least])
    assert all(len({x[1] for x in mine}) == 1 for mine in rows)
    rows = [mine[0] for mine in rows]
    left = []
    for (d, text), (_, _, gone, _) in zip(rows, slow_removal(rows)):
        words = SPACED.findall(text)
        left.append((d, text, gone, len(words)))
    kept = hits([(d, t) for d, t, gone, _ in left if not gone], items)
    want = c.Counter((d, sha(t.encode())) for (d, t), h in zip([(d, t) for d, t, gone, _ in left if not gone], kept) if not h[5])
    have = c.Counter((r["doc_id"], r["decoded_sha256"]) for r in got)
    assert not want - have and len(got) <= len(rows) and len(got) - sum(want.values()) <= sum(1 for x in left if x[2])
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
