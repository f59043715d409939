"""Row-wise operators against brute force, the reference libraries and round trips."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetpulse.llm import bpe, chat_layouts, decision_list, hilbert_pack, line_blocks, wordpiece_counts
from fleetpulse.llm.common import prepare, utf8, words

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  two  spaces \n\n tab\t\tend ", "é你😀" * 50, "x" * 5000, "it's 'twas <|endoftext|> </s>", "a b c " * 3000, "a", "a"]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    own = spark.createDataFrame([(i - 50, t, "en", "s", 1) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").select(own.columns).union(own).cache()


def multilingual():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    return bpe.from_ranks(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_tiktoken(docs, spark):
    spec, own = multilingual()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs, spec).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.digests(docs.limit(0), spec).count() == 0


def test_bpe_every_code_point_of_some_planes():
    spec, own = multilingual()
    chars = [chr(c) for c in (*range(0x3100), *range(0x1F000, 0x1F800))]
    texts = [" ".join(f"a{c}b 1{c}{c} x" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    flat, at = bpe.codec(spec).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [own.encode_ordinary(t) for t in texts]


def test_bpe_spans_pieces_and_clashing_columns(docs, spark):
    spec, _ = multilingual()
    rows = bpe.encode(docs.withColumn("ids", F.lit("clash")), spec, spans=True).collect()
    codec = bpe.codec(spec)
    for r in rows:
        text = r.text or ""
        assert codec.decode(r.ids) == text == "".join(codec.decode_pieces(r.ids))
        assert all(0 <= a < b <= len(text) for a, b in zip(r.ids_start, r.ids_end))
        assert r.lang is not None


def test_line_blocks(spark):
    prepare(spark)
    extract = line_blocks.extract
    assert extract(None) == extract("") == extract("<nav>menu</nav><script>x<p>y</script>") == ""
    page = "<title>t</title><nav>m</nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four&nbsp;five<div class='ad'>no</div></article><footer>f</footer>"
    assert extract(page) == "A & B one two three four five"
    assert extract("<p>" + "word " * 40 + "<p>tail</p><div id=comments><p>no</p></div>") == ("word " * 40).strip() + " tail"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in line_blocks.main_text(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [line_blocks.entities.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[r.page_id].text == " ".join(" ".join(p.split()) for p in parts if p.strip())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "page_id long, html string")
    assert {r.text for r in line_blocks.main_text(odd).collect()} == {""}


def test_line_blocks_unclosed_boilerplate_ends():
    extract = line_blocks.extract
    assert extract("<article><p class=ad>Buy<p>One.</p><p>Two.</p></article>") == "One. Two."
    assert extract("<article><div><p class=notice>x</div><p>Article</article>") == "Article" == extract("<article><div><p class=notice>x</div>Article</article>")
    assert extract("<main><ul><li class=ad>Buy<ul><li>now</ul> or<li>One<li>Two</ul></main>") == "One Two"
    assert extract("<main><table><tr><td class=ad>Buy<td>One<tr class=ad><td>Buy<tr><td>Two</table></main>") == "One Two"
    assert extract("<main><dl><dt class=ad>Buy<dd>One<dt>Two</dl><b><div class=ad>Buy</b> now</div>Three</main>") == "One Two Three"
    assert extract("<main><p><span class=ad>Buy</p><p>One</main>") == "One" == extract("<head><title>t</title><body><main>One")


def test_line_blocks_hints_never_drop_an_article():
    extract = line_blocks.extract
    for names in ("class=content-sidebar-wrap", "class='has-sidebar x'", "id=comments-open", "class=with-share", "class=layout_ad_free", "class=entry-related", "class=sidebar"):
        assert extract(f"<body><div {names}><div><article><p>One.</p></article></div></div>") == "One.", names
        assert extract(f"<body><article {names}><p>One.</p></article>") == "One." == extract(f"<main {names}>One.</main>"), names
    for names in ("class=content-sidebar-wrap", "class=layout_ad_free"):
        assert extract(f"<body><div {names}><p>One.</p></div>") == "One.", names
    for names in ("class=sidebar", "class='x ad'", "id=comments"):
        assert extract(f"<article>One<div {names}><p>Buy<div>now</div></div><p>Two</article>") == "One Two", names
        assert extract(f"<article>One <span {names}>Buy</span> Two</article>") == "One Two", names
    assert extract("<article>One</article><div class=ad><p>Buy") == "One" and extract("<p class=ad>Buy<p>One") == "One"
    assert extract("<div class=ad><a href=x>Buy</div><p>One t<b class=top-ad>w</b>o") == "One two"


def test_line_blocks_teaser_is_not_the_article():
    extract = line_blocks.extract
    long = [" ".join([w] * 60) for w in ("one", "two", "three")]
    body = "".join(f"<p>{x}</p>" for x in long)
    teaser = "<article class=card><h3>Teaser</h3><p>Read this too.</p></article>"
    for page in (f"<div>{body}</div>{teaser}", f"{teaser}<div>{body}</div>", f"<div><p>{long[0]}</p>{teaser}<p>{long[1]}</p><p>{long[2]}</p></div>"):
        got = extract(page)
        assert all(x in got for x in long), page
    assert extract(f"<main>{body}</main><div><p>Other text outside.</p></div>") == " ".join(long)
    assert extract(f"<main>{body}</main><ul><li><a href=x>{long[0] * 3}</a></ul>") == " ".join(long)


def test_line_blocks_keeps_short_and_linked_lines_between():
    extract = line_blocks.extract
    a, b = " ".join(["one"] * 60), " ".join(["two"] * 60)
    assert extract(f"<div><p>{a}</p></div><div><p>Sh is.</p></div><div><p>{b}</p></div>") == f"{a} Sh is. {b}"
    assert extract(f"<div><div><div><h2>Head</h2></div></div></div><div><p>{a}</p></div>") == f"Head {a}"
    assert extract(f"<div><p>{a}</p></div><div><div><p>End.</p></div></div>") == f"{a} End."
    links = "".join(f"<li><a href=x>Ref {i}</a></li>" for i in range(5))
    refs = " ".join(f"Ref {i}" for i in range(5))
    assert extract(f"<div><p>{a}</p><ul>{links}</ul><p>{b}</p></div>") == f"{a} {refs} {b}"
    assert extract(f"<ul>{links}</ul><div><p>{a}</p></div><div><ul>{links}</ul></div><div><p>{b}</p></div><ul>{links}</ul>") == f"{a} {b}"
    assert extract(f"<h1>Title</h1><div class=ad>Buy</div><p>{a}</p><nav>x</nav><p>Sh is.</p><nav>x</nav><p>{b}</p>") == f"Title {a} Sh is. {b}"


def test_line_blocks_without_articles_equal_brute_force():
    import duckdb

    pages = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for around in ("div", "form id=aspnetForm", "div class='widget x'", "section"):
        name = around.split()[0]
        for page_id, html in pages:
            body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
            parts = [line_blocks.entities.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1|br)>", body)]
            want = " ".join(" ".join(p.split()) for p in parts if p.strip())
            page = html.replace("<article>", f"<{around}>").replace("</article>", f"</{name}>")
            assert line_blocks.extract(page) == want, (page_id, around)


def test_line_blocks_comments_teasers_and_odd_markup():
    extract = line_blocks.extract
    long, talk = " ".join(["word"] * 60), " ".join(["talk"] * 80)
    art = f"<article><p>{long}</p></article>"
    for page in (
        f'{art}<div id="comments" class="comments-area"><ol><li><article class="comment-body"><p>{talk}</p></article></ol></div>',
        f'<article><p>{long}</p><section class="comments"><article class="comment"><p>{talk}</p></article></section></article>',
        f'{art}<div class="related"><article><h3>T</h3><p>{talk}</p></article></div>',
        f'<div title="The hidden city">{art}</div>', f'<article data-hidden="false"><p>{long}</article>',
        f'<article data-role="navigation"><p>{long}</article>', f'{art}<div width=5 id="sidebar"><p>{talk}',
        f'<form id="aspnetForm"><div><p>{long}</p></div></form>', f'<form id="aspnetForm"><nav>m</nav>{art}<footer>f</footer></form>',
        f'<div class="widget"><p>{long}</p></div><nav>{talk}</nav>', f"<title-card>x</title-card>{art}", f"<p title=it's>{long}</p>",
        f'<div id="a" class="x" id="sidebar"><p>{long}</p></div><p>Sh.', f"<div class=comments-open><p>{long}</p></div>",
        f'<p title="a>b">{long}</p>', f"<p class=x hidden>{talk}</p>{art}", f"<div class=notice>{talk}</div><div><p>{long}</p></div>",
    ):
        assert extract(page).replace(" Sh.", "").replace("x " + long, long) == long, page
    assert extract(f"<article><p>{long}</p><figure><figcaption>Cap.</figcaption><pre>a = 1</pre></figure><p class=social>Soc.</p></article>") == f"{long} Cap. a = 1 Soc."
    assert extract("<div class=notice><p>Only this.</p></div>") == "Only this." and extract("<div id=comments><p>Only this.</p></div>") == ""
    assert extract("a < b <p>c <3 d</p></><!-- x --!>") == "a < b c <3 d"


@pytest.mark.parametrize("part", ["<a '", "<p><div>", "<li>", "<div class=ad>a ", "<form>a ", "<a b='x>", " <p>x", "<b></i>", "<table><tr><td>x", "<article class=related>x y"])
def test_line_blocks_time_is_linear(part):
    import time

    took = []
    for chars in (100_000, 400_000):
        began = time.process_time()
        line_blocks.extract(part * (chars // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 6


def test_hilbert_curve_steps_by_one_cell():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_pack.hilbert(grid, 3)
    assert sorted(keys) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pack_pieces(docs, spark):
    import zlib

    model = hilbert_pack.read_model(P.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    pieces = hilbert_pack.pack(docs, model, P.PATTERN).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for r in docs.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for own_pieces in by_seq.values():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # full or a power of two: no padding
    assert hilbert_pack.pack(docs.limit(0), model, P.PATTERN).count() == 0


def test_pack_gives_added_tokens_their_ids(spark, tmp_path):
    import zlib

    import corpus_pipeline

    from fleetpulse.llm import queries

    mark = "<|endoftext|>"
    rows = [f"hi {mark} there", mark, f" {mark}{mark}  \n{mark} x ", f"<|end{mark}oftext|>", "<|endoftext |>", f"tail \n\n{mark}", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(rows)}
    assert want[0] == [5303, 220, 50256, 612, 0]
    for pieces in (queries.QUERIES["op3_hilbert_pack"](spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, SF)):
        got = pieces.collect()
        assert {p.doc_id for p in got} == set(want)
        for p in got:
            ids = want[p.doc_id]
            assert (p.doc_tokens, p.ids_crc32) == (len(ids), zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()))


roles = st.sampled_from(["user", "assistant", "system", "", "a\nb", "<|im_end|>\n"])
texts = st.text(alphabet=st.sampled_from(list("\\n<|>[]/INSTim_endstart \n")), max_size=30) | st.sampled_from(chat_layouts.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=5))
def test_chat_template_reads_back(turns):
    text, spans = chat_layouts.render(turns)
    assert chat_layouts.read_back(text) == turns
    assert [chat_layouts.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    inside = text.replace(chat_layouts.TURN_OPEN, "", len(turns)).replace(chat_layouts.TURN_CLOSE, "")
    assert not any(c in inside.replace(chat_layouts.TURN_OPEN.strip(), "") for c in ("[INST]", "</s>", "<<SYS>>"))


def test_chat_layouts_by_fingerprint(spark):
    import json

    prepare(spark)
    two = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "meta": {"x": [1]}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a", "id": 3},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"rows": [{"turn": 0, "role": "user", "text": "q"}, {"turn": 1, "role": "assistant", "text": "a"}]},
    ]
    for r in records:
        assert chat_layouts.canonical(json.dumps(r))[1] == two, r
    for r in (None, "", "[1]", "{", '{"what": 1}', '{"messages": []}'):
        assert chat_layouts.canonical(r) == (None, [])
    df = spark.createDataFrame([(i, json.dumps(r), "clash") for i, r in enumerate(records)] + [(99, None, "c")], "k long, record string, layout string")
    out = chat_layouts.format_records(df).collect()
    assert [r.layout for r in sorted(out, key=lambda r: r.k)][-1] is None and len(out) == len(records) + 1
    rows = spark.createDataFrame([(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat_layouts.digests(chat_layouts.format_records(chat_layouts.rows_to_records(rows)), key="conv_id").collect()}
    assert got == {1: 3, None: 1}


def greedy(word, vocabulary):
    symbols, at, n = [bytes([b]) for b in word] + [b"$$END"], 0, 0
    while at < len(symbols):
        for end in range(len(symbols), at, -1):
            if b"".join(symbols[at:end]) in vocabulary:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_chat_layouts_of_mixed_records(spark):
    import json

    say = chat_layouts.canonical
    two = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    for _ in range(2):  # a fingerprint's choice is kept
        assert say(json.dumps({"prompt": "q", "prompt_id": "7", "messages": two})) == ("messages", [("user", "q"), ("assistant", "a")])
        assert say(json.dumps({"instruction": "i", "response": "r", "output": "o"})) == ("instruction", [("user", "i"), ("assistant", "o")])
        assert say(json.dumps({"messages": [], "prompt": "q", "response": "a"})) == ("prompt_response", [("user", "q"), ("assistant", "a")])
        assert say(json.dumps({"text": "x"})) == (None, []) == say("[1]") == say("{")
    parts = [{"type": "text", "text": "a "}, "b"]
    assert say(json.dumps({"messages": [{"role": "user", "content": parts}]})) == ("messages", [("user", "a b")])
    picture = [{"type": "image", "url": "u"}]
    assert say(json.dumps({"messages": [{"role": "user", "content": picture}]}))[1] == [("user", json.dumps(picture))]
    rows = spark.createDataFrame([(1, json.dumps({"messages": two})), (2, "{}"), (3, None)], "id long, record string")
    counts = {r.layout: r.n for r in chat_layouts.layout_counts(chat_layouts.format_records(rows)).collect()}
    assert counts == {"messages": 1, None: 2}


def test_long_words_take_linear_time():
    import time

    vocabulary = [(b"a", False), (b"aa", False), (b"aaa", True), (b"b", True), (b"ab", False), (b"c", False), (b"c", True)]
    auto = wordpiece_counts.Automaton(vocabulary)
    rnd = random.Random(3)
    some = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 5, 200, 256, 257, 300, 1000) for _ in range(20)] + ["a" * 400, "b" * 400, "x" * 300]
    data, off = np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0, *map(len, some)])
    got = auto.counts(data, off[:-1], off[1:])
    assert got.tolist() == [auto.count_one(w.encode()) for w in some]
    one = wordpiece_counts.Automaton([(bytes([b]), e) for b in range(33, 127) for e in (False, True)])
    big = np.full(10_000_000, 65, np.uint8)
    began = time.process_time()
    assert one.counts(big, np.array([0]), np.array([len(big)])).tolist() == [len(big)]
    assert time.process_time() - began < 20


def test_automaton_equals_greedy():
    rnd = random.Random(5)
    for _ in range(200):
        vocabulary = [(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))), rnd.random() < 0.4) for _ in range(rnd.randint(0, 12))]
        held = {b + (b"$$END" if e else b"") for b, e in vocabulary}
        some = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 9))) for _ in range(20)]
        data = np.frombuffer(b" ".join(some), np.uint8)
        start, end, _ = words(data, np.array([0, len(data)]))
        assert wordpiece_counts.Automaton(vocabulary).counts(data, start, end).tolist() == [greedy(w, held) for w in some]


def test_token_counts(docs):
    vocabulary = wordpiece_counts.read_vocabulary(P.path("word_bpe_49k.json"))
    held, known = {b + (b"$$END" if e else b"") for b, e in vocabulary}, {}
    got = {r.doc_id: (r.n_tokens, r.n_words) for r in wordpiece_counts.count_tokens(docs.withColumn("n_words", F.lit("x")), vocabulary).collect()}
    for r in docs.where("doc_id < 40").collect():
        own = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()))
        assert got[r.doc_id] == (sum(known.setdefault(w, greedy(w, held)) if len(w) < 200 else 0 for w in own) if max(map(len, own), default=0) < 200 else got[r.doc_id][0], len(own))


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            cover |= {i + k for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_statistics_equal_brute_force(docs, spark):
    rnd = random.Random(3)
    more = [(1000 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))) for i in range(100)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("kept_text", F.col("text"))
    for r in decision_list.judge(both.withColumn("w", F.lit(1)).withColumn("rule", F.lit("x")), decision_list.DecisionList(())).collect():
        own = base(r.kept_text)
        assert tuple(r[c] for c in decision_list.BASE) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and r.kept == (not r.base_failed)


def test_statistics_keep_columns_of_any_name(spark):
    names = ("w", "_t", "t", "_lines", "lines", "_chars", "chars", "row", "upper", "marks", "n_lines", "_row", "a b")
    df = spark.createDataFrame([(5, "one two three one two three")], "doc_id long, text string")
    df = df.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    got = decision_list.judge(df, decision_list.DecisionList(())).first()
    assert [got[c] for c in names] == list(range(len(names))) and (got.doc_id, got.n_words, got.n_repeat_words) == (5, 6, 6)
    kept = decision_list.keep(df.withColumn("text", F.repeat(F.col("text"), 1)), decision_list.DecisionList(()))
    assert kept.columns == df.columns


def test_repeat_words_of_colliding_hashes(spark, monkeypatch):
    """With a hash of one value all windows are neighbours, and the words decide."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(60)] + [" ".join(str(i) for i in range(40))]
    monkeypatch.setattr(decision_list, "_REPEAT_WORDS", decision_list._REPEAT_WORDS.replace(
        "xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))", "pmod(xxhash64(get(w, i)), 2L)"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in decision_list.statistics(df).collect():
        w = texts[r.doc_id].split()
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert r.n_repeat_words == len({k + d for k, x in enumerate(wins) if wins.count(x) > 1 for d in range(3)}), w


def test_decision_list_learns_and_handles_missing_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rules = decision_list.learn(docs, labels.where(~held_out))
    assert rules.rules
    judged = decision_list.judge(docs, rules).join(labels.where(held_out), "doc_id").where("not base_failed")
    right = judged.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")).alias("a")).first().a
    assert right > 0.95, (right, str(rules))
    kept = decision_list.keep(docs.withColumn("n_words", F.lit("clash")), rules)
    assert kept.columns == [*docs.columns, "n_words"] and 0 < kept.count() < docs.count()
    assert decision_list.learn(docs, labels.limit(0)).rules == () == decision_list.learn(docs.limit(0), labels).rules
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id long, quality int")
    assert decision_list.learn(docs, nulls).rules == ()


def test_decision_lists_use_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = decision_list.DecisionList(((decision_list.Condition("symbol_share", True, 0.1),),))
    plan = decision_list.judge(docs, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_utf8_of_slices_and_nulls():
    col = pa.array(["ab", None, "", "é"]).slice(1, 3)
    data, off = utf8(col)
    assert bytes(data) == "é".encode() and off.tolist() == [0, 0, 0, 2]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]
