"""Operators 2, 5, 7 and 9 and the pipeline: brute force, round trips, held-out accuracy, odd tables."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import bpe, html_text, imatch, mil
from barloom.llm.queries.texts import TOKENIZER, op2_html_extraction, op5_fingerprints, op7_bpe, op9_quality_classifier

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, __id string, score double"
ODD = [(1, None), (2, ""), (3, "same text again"), (3, "same text again"), (4, "long word " * 30_000), (None, "no id"), (None, None), (2**60, " \n\t"), (5, "same text again")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", 0.5) for i, t in rows], SCHEMA)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# --- 2

BODY = "<h1>Title</h1><p>First &amp; long paragraph of an article,\n with   several words in it.</p><p><b>Second</b> paragraph<br>goes on for quite a while, too."
WANT = "Title\n\nFirst & long paragraph of an article, with several words in it.\n\nSecond paragraph goes on for quite a while, too."
FRAME = [
    "{}", "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=a>Menu</a></nav><article>{}</article><footer>Foot text here</footer></body></html>",
    "<body><header><h1>Site</h1></header><div class='sidebar widget'><p>Aside words, many of them, in a long line of text</p></div><div id=main>{}</div><div class=comments><p>I say this and that</p></div>",
    "<div class=page><div class='has-sidebar'>{}</div></div><aside>Read more</aside><form>Name <input name=x><button>Go</button></form><script>var x = '<p>no</p>';</script><!-- <p>no</p> -->",
    "<article>{}</article><div class='cookie-notice'>We use cookies</div><div class=ad>Buy now</div><section id=comments><article class=comment><p>A reader says something at length here</p></article></section>",
]


@pytest.mark.parametrize("frame", FRAME)
def test_main_text(frame):
    assert html_text.main_text(frame.format(BODY)) == WANT


def test_content_without_marks_is_found_by_density():
    links = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div>{BODY}</p><p>{'Plain words follow here. ' * 10}</p></div></div><div><a href=x>imprint</a></div></body>"
    got = html_text.main_text(page)
    assert got.startswith(WANT) and "Link number" not in got and "imprint" not in got


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<p>", ""), ("just words", "just words"), ("<p>cut &amp; off <a hre", "cut & off"), ("<nav>menu</nav>", ""), ("&lt;p&gt; &#233;&nbsp;x", "<p> é x"), ("<div>" * 3000 + "deep", "deep"), ("a < b", "a < b")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


ARTICLE = BODY.replace("Title", "Title, too") + " Words and more words of it follow here.</p>"
KEPT = WANT.replace("Title", "Title, too") + " Words and more words of it follow here."


@pytest.mark.parametrize("mark", ["class='long-form'", "class=legal-news", "class='search-result-text'", "class='elementor-element elementor-widget elementor-widget-text-editor'", "aria-label='Search result text'", "id=form"])
def test_articles_below_marking_names(mark):
    assert html_text.main_text(f"<body><nav>Menu</nav><div {mark}>{ARTICLE}</div></body>") == KEPT
    if mark != "id=form":
        page = f"<div {mark}>{ARTICLE}</div><div class='sidebar-left'><p>Aside words in a line</p></div><div class=comments>{'<p>I say this and that</p>' * 50}</div><div>End</div>"
        assert html_text.main_text(page).startswith(KEPT) and not set("Aside I".split()) & set(html_text.main_text(page).split())
        # an article in several parts of one name
        parts = "".join(f"<div {mark}><p>Part {i} of an article that goes on for a while.</p></div>" for i in range(9))
        assert html_text.main_text(f"<div>{parts}</div><div class='site-ads'>Buy now</div>") == "\n\n".join(f"Part {i} of an article that goes on for a while." for i in range(9))


@pytest.mark.parametrize("mark", ["comments", "comments-area", "cookie-consent-box", "sidebar"])
def test_firm_marks_hold_whatever_their_size(mark):
    assert html_text.main_text(f"<body><div>{BODY}</p></div><div class={mark}>{'<p>I say this and that, at length</p>' * 99}</div></body>") == WANT


def test_raw_elements_after_letters_that_grow_in_lower_case():
    for n in (1, 9, 40):
        page = f"<p>{'İ' * n}</p><script>var a = 1 > 0;</SCRIPT>Text right <b>after</b> it.<style>p > a {{}}</style><p>More of it.</p>"
        assert html_text.main_text(page) == f"{'İ' * n}\n\nText right after it.\n\nMore of it."


def test_densities_against_the_definition():
    rnd = random.Random(5)

    def grow(depth):
        """A random tree: (tag, parts), each part a text or a tree."""
        parts = [rnd.choice(["", "x" * rnd.randint(1, 90), "some words here"]) if rnd.random() < 0.5 or depth > 4 else grow(depth + 1) for _ in range(rnd.randint(0, 5))]
        return (rnd.choice(["div", "div", "section", "blockquote"]) if rnd.random() < 0.7 or depth < 1 else "a", parts)

    def show(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(show, t[1]))}</{t[0]}>"

    def no_nested_links(t, inside=False):
        return isinstance(t, str) or (not (inside and t[0] == "a") and all(no_nested_links(x, inside or t[0] == "a") for x in t[1]))

    def counts(t, inside=False):
        """C, T, LC, LT below a node."""
        c = tags = lc = lt = 0
        for x in t[1]:
            if isinstance(x, str):
                c += len(x.replace(" ", ""))
                lc += len(x.replace(" ", "")) * (inside or t[0] == "a")
            else:
                d = counts(x, inside or t[0] == "a")
                c, tags, lc, lt = c + d[0], tags + d[1] + 1, lc + d[2], lt + d[3] + (x[0] == "a")
        return c, tags, lc, lt

    def density(t, body, inside=False):
        c, tags, lc, lt = counts(t, inside)
        if not c:
            return 0.0
        if not lc:
            return c / max(1, tags)
        inner = np.log(c / max(1, c - lc) * lc + body[2] / body[0] * c + np.e)
        return c / max(1, tags) * max(0.0, np.log(c / lc * max(1, tags) / max(1, lt))) / np.log(inner + np.e - 1)

    def walk(t, inside=False):
        yield t, inside
        for x in t[1]:
            if not isinstance(x, str):
                yield from walk(x, inside or t[0] == "a")

    done = 0
    while done < 60:
        body = ("body", [grow(0) for _ in range(3)])
        if not no_nested_links(body):
            continue
        done += 1
        page, whole = html_text.Page("".join(map(show, body[1]))), counts(body)
        nodes = list(walk(body))
        assert page.tag == [t[0] for t, _ in nodes]
        assert page.densities == pytest.approx([density(t, whole, i) for t, i in nodes])
        assert page.sums == pytest.approx([sum(density(x, whole, i or t[0] == "a") for x in t[1] if not isinstance(x, str)) for t, i in nodes])


def slow_choice(root, marks):
    """The text of a tree (tag, parts) by the definition of core, threshold, scope and pruning; marks: numbers of nodes in document order."""
    nodes, parents = [], []

    def number(t, parent):
        i = len(nodes)
        nodes.append(t)
        parents.append(parent)
        for x in t[1]:
            if not isinstance(x, str):
                number(x, i)

    number(root, -1)
    page = html_text.Page("".join(map(shown, root[1])))  # densities and sums have a test of their own
    assert page.tag == [t[0] for t in nodes]
    up = lambda i: [i, *(up(parents[i]) if i else [])]
    cut = {i for i in range(len(nodes)) if set(up(i)) & marks}
    core = min((i for i in range(len(nodes)) if i not in cut), key=lambda i: (-page.sums[i], i))
    path = up(core)
    scope = next((i for i in path if nodes[i][0] in ("article", "main")), 0)
    threshold = min(page.densities[i] for i in path)
    block = lambda i: nodes[i][0] != "a"

    def own_reason(i):
        dense = page.densities[i] >= threshold or (nodes[i][0] in html_text.HEADINGS and not page.link_chars[i])
        return i == core or (block(i) and i != scope and i not in path and dense)

    taken = {i for i in range(len(nodes)) if scope in up(i) and any(own_reason(j) for j in up(i)[: up(i).index(scope)]) or i == core}
    if core == scope:
        taken |= {i for i in range(len(nodes)) if scope in up(i)}
    out, count = [], iter(range(len(nodes)))

    def collect(t, owner):
        i = next(count)
        mine = i if block(i) else owner
        if block(i):
            out.append([])
        for x in t[1]:
            if isinstance(x, str):
                out[-1].append((mine, x))
            else:
                collect(x, mine)
        if block(i):
            out.append([])

    collect(root, 0)
    texts = []
    for parts in out:
        parts = [(o, x) for o, x in parts if x]
        text = " ".join("".join(x for _, x in parts).split())
        if text and parts[0][0] not in cut and (parts[0][0] in taken or parts[0][0] == scope):
            texts.append(text)
    return "\n\n".join(texts)


def shown(t):
    return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(shown, t[1]))}</{t[0]}>"


def test_choice_and_pruning_against_the_definition():
    rnd = random.Random(9)

    def grow(depth, inside_link=False):
        parts = [rnd.choice(["", "x" * rnd.randint(1, 90), " some words here "]) if rnd.random() < 0.4 or depth > 4 else grow(depth + 1, inside_link) for _ in range(rnd.randint(0, 5))]
        return (rnd.choice(["div", "div", "section", "blockquote", "article", "h3"]) if rnd.random() < 0.8 or depth < 1 else "a", parts)

    def links_alone(t, inside=False):
        return isinstance(t, str) or (not (inside and t[0] in ("a", "h3")) and all(links_alone(x, inside or t[0] in ("a", "h3")) for x in t[1]))

    done = chosen = 0
    while done < 300:
        body = ("body", [grow(0) for _ in range(4)])
        if not links_alone(body):
            continue
        done += 1
        page = html_text.Page("".join(map(shown, body[1])))
        blocks = [i for i in range(1, len(page.tag)) if page.tag[i] != "a"]
        for marks in (set(), set(rnd.sample(blocks, min(2, len(blocks))))):
            got = page.text(marks)
            chosen += bool(got)
            assert got == slow_choice(body, marks)
    assert chosen > 300


@pytest.mark.parametrize("page", [
    f"<body><form action='/go' method=post><div>{ARTICLE}</div></form></body>", f'<body><div class="lg:flex hidden md:block">{ARTICLE}</div></body>',
    f'<body><article title="The hidden truth">{ARTICLE}</article></body>', f'<body><article data-x="a aria-hidden=true display: none">{ARTICLE}</article></body>',
    f"<body><header>{ARTICLE}</header></body>", f"<body><div hidden>{ARTICLE}</div></body>", f"<body><aside>{ARTICLE}</aside></body>",
])
def test_articles_inside_hard_parts_stay(page):
    assert html_text.main_text(page) == KEPT


@pytest.mark.parametrize("hide", ["hidden", "hidden=''", "HIDDEN=until-found", "aria-hidden=true", 'aria-hidden="TRUE"', "style='color: red; display : none'", "class=x hidden id=y"])
def test_hidden_parts_go_by_the_name_of_the_attribute(hide):
    assert html_text.main_text(f"<body><article>{ARTICLE}</article><div {hide}>Not to be seen at all.</div></body>") == KEPT
    assert html_text.main_text(f"<body><article>{ARTICLE}<p {hide}>Not to be seen.</p></article></body>") == KEPT


def test_density_chooses_without_names_and_articles(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [html_text.main_text(p) for p in pages]
    assert np.mean([html_text.Page(p).text(set()) == w for p, w in zip(pages, want, strict=True)]) > 0.9
    plain = [p.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div") for p in pages]
    assert np.mean([html_text.main_text(p) == w for p, w in zip(plain, want, strict=True)]) > 0.95


@pytest.mark.parametrize("unit", ["<div>", "<span class='x-ad y'>", "<center><hr>", "<p><td><center><hr>", "<ul><li>", "</div><div>", "<a href=x><div class=widget-a>"])
def test_deep_pages_take_linear_time(unit):
    began = time.process_time()
    assert html_text.main_text(unit * 32_000 + "deep").endswith("deep")
    assert time.process_time() - began < 6


def test_pages_query(spark):
    out = op2_html_extraction(spark, SF)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(pages) and out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0 and "track(" not in r["text"] and r["text"] == html_text.main_text(pages[r["page_id"]])
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (2**60, None, "<p>x", "t"), (2**60, None, "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, (tuple(r) for r in html_text.extract(odd).collect()))) == sorted(map(str, [(1, None, "", 0), (None, "u", "", 0), (2**60, None, "x", 1), (2**60, None, "x", 1)]))


# --- 5


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def slow_fingerprints(docs, low=imatch.LOW, high=imatch.HIGH):
    """What the contract of a fingerprint says, text by text: a function of a text to its list of hashes."""
    own = lambda t: {signed(xxhash.xxh64_intdigest(w.lower(), 42)) for w in (t or "").encode().split()}
    df = Counter(h for _, t in docs for h in own(t))
    lexicon = {h for h, n in df.items() if max(1, low * len(docs)) <= n <= max(1, high * len(docs))}

    def one(t):
        kept = sorted(own(t) & lexicon)
        out = [None if kept else xxhash.xxh64_intdigest((t or "").encode(), 42)]
        pair = lambda h, n: h >> 2 * n & 3
        keys = [[(v,) for v in range(4)], [(v, w) for v in range(4) for w in range(4)]]
        for level in (2, 3, 4):
            keys.append([(*k, 0) for k in keys[level - 1]])
        for level in keys:
            for key in level:
                part = [h for h in kept if all(pair(h, n) == v for n, v in enumerate(key))]
                seed = 42
                for h in part:
                    seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
                out.append(seed if part else None)
        return out

    return one


def slow_likeness(a, b):
    if a[0] is not None or b[0] is not None:
        return float(a[0] == b[0])
    at, found = 1, 0.0
    for n in imatch.LEVELS:
        pairs = [(x, y) for x, y in zip(a[at : at + n], b[at : at + n], strict=True) if x is not None or y is not None]
        if pairs and (2 * len(pairs) >= n or at == 1):
            found = sum(x == y for x, y in pairs) / len(pairs)
        at += n
    return found


@pytest.mark.parametrize("broadcast", [True, False])
def test_fingerprints_query(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    docs = documents(spark)
    fp = slow_fingerprints(docs)
    show = lambda f: "-".join("" if h is None else f"{h & 0xFFFFFFFF:08x}" for h in f)
    got = {r["doc_id"]: r for r in op5_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    near = []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[1][:half]
        r, own, edited = got[d], fp(t), fp(changed)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == show(own) and r["edited_fingerprint"] == show(edited)
        assert r["near_edited"] == pytest.approx(slow_likeness(own, edited)) and r["near_next"] == pytest.approx(slow_likeness(own, fp(following[1])))
        near.append((r["near_edited"], r["near_next"]))
    assert np.mean([a for a, _ in near]) > 0.15 > 5 * np.mean([b for _, b in near])
    assert len({r["fingerprint"] for r in got.values()}) >= 0.98 * len({t for _, t in docs})


def far_off(spark):
    """3,000 near ids, one far away, 2,500 rows without an id and 1,500 that share one."""
    ids = [*range(3000), 2**61, -(2**62), *[None] * 2500, *[77] * 1500]
    return spark.createDataFrame([(d, f"text {n}") for n, d in enumerate(ids)], "doc_id long, text string")


def test_stretches_are_even_on_any_ids(spark):
    df = far_off(spark)
    rows = imatch.with_next(df).collect()
    sizes = {}
    for r in rows:
        sizes[r["__at"]] = sizes.get(r["__at"], 0) + 1
    assert max(sizes.values()) <= imatch.STRETCH + 1
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [r["text"] for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]
    assert {r["__body"]: r["__next"] for r in rows if not r["__tail"]} == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_lexicon_is_the_band(spark):
    docs = documents(spark)
    df = {}
    for _, t in docs:
        for w in set(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()):
            df[w] = df.get(w, 0) + 1
    want = sum(0.02 * len(docs) <= n <= 0.1 * len(docs) for n in df.values())
    assert imatch.lexicon(table(spark, docs), low=0.02, high=0.1).count() == want


def test_small_edits_stay_near(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rnd.sample(words, 30))) for i in range(200)]
    near = [(1000 + i, t + f" typo{i}") for i, (_, t) in enumerate(docs[:50])]
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(table(spark, docs + near), lex=imatch.lexicon(table(spark, docs), low=0.02, high=0.5)).collect()}
    assert all(got[1000 + i] == got[i] for i in range(50))
    assert sum(got[i] == got[i + 1] for i in range(199)) == 0


def test_fingerprints_odd_tables(spark):
    assert imatch.compare_with_edits(table(spark, [])).count() == 0
    rows = imatch.compare_with_edits(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (3, 5)}) == 1
    assert len(imatch.fingerprints(table(spark, ODD)).collect()) == len(ODD)
    only = imatch.compare_with_edits(table(spark, [(7, "abcd")])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and only["near_next"] == 1.0


# --- 7

STRANGE = ["", "  a  b\n\n c", "aaaaaaaaa", "<|endoftext|>x<|endoftext|>", "日本語　テスト ½ ٣", "it's we'll\r\n \t", "\n" * 40, "é नमस्ते 👩‍👩‍👧", "\x1c\x85\xa0 z", "x" * 300]


def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(TOKENIZER)
    docs = documents(spark)
    got = {r["doc_id"]: r for r in op7_bpe(spark, SF).collect()}
    for d, t in docs:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_are_encoded_but_not_counted(spark):
    from tokenizers import Tokenizer

    texts = [(i, f"short word {'ab' * 5000} {'é' * 40} word{'=' * 3000}") for i in range(4)]
    words = bpe.frequent_words(table(spark, texts))
    assert " word" in words and max(len(w.encode()) for w in words) <= bpe.LONGEST
    library = Tokenizer.from_file(TOKENIZER)
    want = np.array(library.encode(texts[0][1], add_special_tokens=False).ids, "<u4").tobytes()
    assert {bytes(r["ids"]) for r in bpe.encode(table(spark, texts), TOKENIZER).collect()} == {want}


def test_lexicon_never_changes_results(tmp_path):
    vocab, lib = bpe.vocabulary(TOKENIZER), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = sorted({w for t in STRANGE for w in bpe._splitter(bpe.PATTERN).findall(t)} | {" the", " then", "hen", "then", " th"})
    (tmp_path / "lex").write_bytes(bpe.compile_lexicon([w.encode() for w in words], vocab))
    lex = bpe.Lexicon(str(tmp_path / "lex"))
    held = sorted(w.encode() for w in words if 0 < len(w.encode()) <= bpe.LONGEST)
    assert lex.find(held).tolist() == list(range(len(held)))
    assert lex.find([b"", b"the", b" thenx", b"zz"]).tolist() == [-1] * 4
    assert len(lex.final) < 1 + sum(map(len, held))  # suffixes are shared
    for lexicon in (None, lex):
        got = bpe.encode_texts([*STRANGE, None], vocab, lexicon)
        assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in [*STRANGE, ""]]
    plain = bpe.encode_texts(["<|endoftext|>"], vocab, None, specials=False)[0].tolist()
    assert 50256 not in plain and b"".join(vocab.bytes[i] for i in plain) == b"<|endoftext|>"


def test_bpe_odd_tables(spark):
    assert bpe.encode(table(spark, []), TOKENIZER).count() == 0
    coded = bpe.encode(table(spark, ODD), TOKENIZER, keep=["doc_id", "score"])
    back = bpe.decode(coded, TOKENIZER, ["doc_id"]).collect()
    assert sorted(map(str, ((r["doc_id"], r["decoded"]) for r in back))) == sorted(map(str, ((i, t or "") for i, t in ODD)))


# --- 9


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality_classifier(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.95


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 2, 7])
    x, y, starts = rng.normal(size=(14, 9)), np.array([0.0, 1, 1, 0]), np.cumsum(sizes) - sizes
    m = mil.fit(x, sizes, y)
    m = mil.Model({k: v + rng.normal(0, 0.3, np.shape(v)) if k in mil.LEARNED else v.astype(float) for k, v in m.p.items()})
    loss = lambda: -np.mean(y * np.log(f := m.score(x, sizes)) + (1 - y) * np.log(1 - f))
    for k, g in mil.gradients(m, x, starts, y).items():
        whole = m.p[k]
        for at in np.ndindex(np.shape(whole)):
            ends = []
            for by in (1e-5, -1e-5):
                m.p[k] = np.array(whole, float)
                m.p[k][at] += by
                ends.append(loss())
            m.p[k] = whole
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(np.array(g)[at], rel=1e-4, abs=1e-8), (k, at)


def test_fit():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 2, 7])
    x, y = rng.normal(size=(14, 9)).astype(np.float32), np.array([0, 1, 1, 0])
    m = mil.fit(x, sizes, y)
    assert np.allclose(np.add.reduceat(m.forward(x, np.array([0, 1, 5, 7]))["a"], [0, 1, 5, 7]), 1)
    assert len(set(mil.fit(x, sizes, np.ones(4)).score(x, sizes).tolist())) == 1
    # one bad passage of many decides: attention finds it
    sizes = np.full(300, 9)
    x = rng.normal(size=(2700, 9)).astype(np.float32)
    y = np.arange(300) % 2
    x[np.arange(0, 2700, 18) + rng.integers(0, 9, 150), 3] += 6
    m = mil.fit(x, sizes, y)
    assert ((m.score(x, sizes) > 0.5) == y).mean() > 0.95


def slow_encode(text):
    """Passages of one text, word by word."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    rows = []
    for k in range(0, max(1, len(words)), mil.PASSAGE):
        row = [0] * (2 * mil.BUCKETS)
        for w in words[k : k + mil.PASSAGE]:
            h = sum((b + 1) * int(mil._PLACES[i & 63]) for i, b in enumerate(w)) % 2**64
            row[(h * 0xD6E8FEB86659FD93) % 2**64 >> 64 - mil.BITS] += 1
            p = b" " + w + b" "
            for i in range(len(w)):
                t = p[i] | p[i + 1] << 8 | p[i + 2] << 16
                row[mil.BUCKETS + ((t * 0x9E3779B1) % 2**32 >> 32 - mil.BITS)] += 1
        rows.append([min(255, v) for v in row])
    return rows


def test_passages_cover_the_whole_text():
    rnd = random.Random(8)
    texts = [None, "", " \n", "word", "word " * 200, "é\tÀB " * 70 + "\n", "x" * 400, *("".join(rnd.choice(["ab ", "c", "É\n", "# ", "\x1c"]) for _ in range(rnd.randint(0, 400))) for _ in range(20)), ""]
    counted, shares, sizes = mil.encode(texts)
    want = [slow_encode(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and counted.tolist() == [r for w in want for r in w]
    alone = [mil.encode([t]) for t in texts]  # a text's passages do not depend on its neighbours
    assert np.array_equal(np.concatenate([a[1] for a in alone]), shares)
    assert np.isclose(shares[4:8, 12], np.log1p([64, 64, 64, 8]) / 4).all() and not shares[:3].any()
    junk = mil.encode(["word " * 200 + "### " * 64])[1]
    assert junk[-1, 0] > shares[7, 0]
    assert all(len(x) == 0 for x in mil.encode([]))


def test_training_takes_whole_documents_within_the_bound(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(mil, "fit", lambda x, sizes, labels: seen.update(sizes=sizes.tolist(), n=len(x)))
    docs = table(spark, [(i, "w " * 64 * (i % 7 + 1)) for i in range(40)] + [(3, "w"), (99, "w " * 64 * 500)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, label int")
    mil.train(docs, labels)
    assert sorted(seen["sizes"]) == sorted([*(i % 7 + 1 for i in range(40)), 500]) and seen["n"] == sum(seen["sizes"])
    mil.train(docs, labels, passages=60)
    assert 54 <= seen["n"] <= 60 and set(seen["sizes"]) <= set(range(1, 8))


def test_scores_of_odd_tables(spark):
    model = mil.train(table(spark, ODD), spark.createDataFrame([(3, 1), (4, 0), (3, 0), (9, 1), (1, None)], "doc_id long, label int"))
    rows = mil.score(table(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows} == {i for i, _ in ODD}
    assert mil.score(table(spark, []), mil.train(table(spark, []), spark.createDataFrame([], "doc_id long, label int"))).count() == 0


# --- pipeline


def test_pipeline(spark):
    lib = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == corpus_pipeline.COLUMNS and 0 < good.count() < docs.count()
    kept = corpus_pipeline.drop_repeated_lines(spark, good, SF).cache()
    assert kept.count() == good.count() and kept.agg(F.sum("n_chars")).first()[0] < good.agg(F.sum("n_chars")).first()[0]
    twice = kept.union(kept.withColumn("doc_id", F.col("doc_id") + 100_000))
    heads = corpus_pipeline.one_of_each_group(spark, twice, SF)
    assert heads.where("doc_id >= 100000 and n_chars > 0").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    last = corpus_pipeline.tokenize(spark, kept, SF)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in last.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    rnd = random.Random(11)
    good = [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(80)) for _ in range(4)]
    rows = [(None, good[0], None, None), (None, good[1], "en", "a"), (1, good[2], "en", None), (1, good[2], "en", None), (1, "short", "en", "a"), (2, None, None, None), (3, "", "fr", "")]
    rows += [(None, None, None, None), (4, good[3], None, "a"), (5, good[3] + " tail", "en", "b"), (6, " ".join(f"v{i}" for i in range(60_000)), "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, k_doc_id long, component_id long"
    at = str(tmp_path)
    spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 1), (77, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.createDataFrame([(*r, None, 1, 2, 3) for r in rows], schema)
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    kept = corpus_pipeline.keep_good(spark, docs, at)
    assert seen(kept) == sorted(((i, t) for i, t, *_ in rows if t and len(t) > 10), key=str)
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, at)
    assert lines.columns == corpus_pipeline.COLUMNS and seen(lines) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    heads = corpus_pipeline.one_of_each_group(spark, docs, at)
    assert seen(heads) == sorted(((i, t) for i, t, *_ in rows if i != 5), key=str)
    mixed = corpus_pipeline.mix_sources(spark, docs, at)
    counts = {(r["doc_id"], r["text"]): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    assert mixed.columns == corpus_pipeline.COLUMNS and set(counts) <= {(i, t) for i, t, *_ in rows} and max(counts.values()) <= 6
    assert any(i is None and t for i, t in counts)
    docs.write.parquet(f"{at}/documents.parquet")
    out = corpus_pipeline.run(spark, at).collect()
    assert out and {r["doc_id"] for r in out} <= {None, 1, 4, 6} and all(r["n_tokens"] > 0 for r in out)
    none = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
