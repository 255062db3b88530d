"""HTML extraction, quality rules, chat templates, edit matching, packing, WARC and the pipeline."""

import gzip
import hashlib
import json
import random
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from palisade.llm import chat_template, edit_match, html_model, packing, quality, queries, warc
from tests.llm.helpers import corpus, documents, tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# ---------------------------------------------------------------- HTML


def test_held_out_pages():
    model, rng = html_model.trained_model(), random.Random(1234)
    right = total = 0
    for _ in range(150):
        page = html_model.Page(html_model.labelled_page(rng))
        for label, m, n in zip(page.label, model.marginals(page), page.chars, strict=True):
            total += n
            right += n * ((label == "1") == (m >= 0.5))
    assert right / total > 0.99


def test_messages_equal_enumeration():
    """Marginals of a small tree, by summing over every assignment."""
    import itertools
    import math

    model = html_model.trained_model()
    page = html_model.Page("<body><nav><ul><li>menu</li></ul></nav><article><h1>Title here</h1><p>Some words, and more.</p></article></body>")
    feats, kinds, n = page.features(), model.kinds(page), len(page.tag)
    weights = [0.0] * n
    total = 0.0
    for ys in itertools.product((0, 1), repeat=n):
        logp = sum(model.odds.get(f, 0.0) for y, fs in zip(ys, feats, strict=True) if y for f in fs)
        for i in range(1, n):
            move = model.moves.get((kinds[page.parent[i]], kinds[i])) or model.moves.get((kinds[i],)) or model.moves[()]
            logp += move[ys[page.parent[i]]][ys[i]]
        p = math.exp(logp)
        total += p
        for i, y in enumerate(ys):
            weights[i] += p * y
    assert [w / total for w in weights] == pytest.approx(model.marginals(page), abs=1e-9)


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("just words, no tags", "just words, no tags"),
    ("<html><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><article><h1>A  b</h1><p>One &amp; two&nbsp;three.<p><b>Four<br>five.</article><footer>&copy; x</footer>", "A b One & two three. Four five."),
    ("<html><body><article><h1>T x</h1><script>var a='</p>';</script><p>Body text, with some words.</p><div class=comments><p>First! Nice one.</p></div></article>", "T x Body text, with some words."),
    ("<html><body><div class=cookie-notice><p>We use cookies.</p></div><article><h1>Head line</h1><p>Good text, good text.</p></article><div class='ad'>Buy now.</div>", "Head line Good text, good text."),
])
def test_extract(html, text):
    assert html_model.extract(html, html_model.trained_model()) == text


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", "<body><article><p>Some text, ok.</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_model.extract_pages(df).collect()) == [(1, "Some text, ok.", 14), (2, "", 0), (2, "", 0)]
    assert html_model.extract_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- quality


def brute_base(text):
    words = [w.decode() for w in tokens(text)]
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    windows = defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k:k + 3])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_rules_equal_brute_force(spark):
    rows = corpus() + [(200, "a b\na b\n\n a b\n#*$ <|> x%\n" * 5), (201, "é ü　ß " * 30)]
    labels = spark.createDataFrame([(10, 1, 0), (3, 1, 0), (200, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(documents(spark, rows), labels)
    assert Counter(tuple(r)[:6] + (r.base_failed,) for r in got.collect()) == Counter((i, *brute_base(t)) for i, t in rows)
    kept = quality.keep_good(documents(spark, rows), labels)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got.filter("kept").collect())


def test_ratio_separates_labelled_junk(spark):
    rng = random.Random(2)
    good = [(k, " ".join(rng.choice(("the", "of", "river", "stone", "walked", "house")) + str(rng.randrange(99)) for _ in range(100))) for k in range(60)]
    junk = [(100 + k, " ".join(rng.choice(("$$$", "###", "%%%")) + str(rng.randrange(99)) for _ in range(100))) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judge_quality(documents(spark, good + junk), labels).collect()}
    assert all(got[i] for i, _ in good)
    assert not any(got[i] for i, _ in junk)


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(documents(spark, []), labels).count() == 0
    assert all(r.score == 0 for r in quality.judge_quality(documents(spark), labels).collect())


# ---------------------------------------------------------------- chat templates


def test_template_language():
    render = chat_template.compile_template("{% set x = 1 + 2 %}{% if x == 3 and not false %}yes {{ name | upper }}{% else %}no{% endif %}{% for m in items %}{{ loop.index }}{{ m.a ~ '!' }}{% if not loop.last %},{% endif %}{% endfor %}{# gone #}")
    assert "".join(t for t, _ in render({"name": "bo", "items": [{"a": "p"}, {"a": "q"}]})) == "yes BO1p!,2q!"


def test_constants_fold():
    tree = chat_template.fold(chat_template.parse("a{{ 'b' ~ 1 }}{% if 1 < 2 %}c{% else %}d{% endif %}"))
    assert tree == (chat_template.Text("ab1c"),)


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ _x }}", "{{ f(1) }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | exec }}", "{% endif %}", "{% import os %}", "{{ 1 + }}"])
def test_sandbox(bad):
    with pytest.raises(chat_template.TemplateError):
        chat_template.compile_template(bad)


def test_guard_round_trip():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\>an\n") for _ in range(rng.randint(0, 12)))
        assert chat_template.unguard(chat_template.guard(text)) == text
        assert "<|" not in chat_template.guard(text)
        assert chat_template.unguard_line(chat_template.guard_line(text)) == text
        assert "\n" not in chat_template.guard_line(text)


@pytest.mark.parametrize("part_chars", [4 << 20, 30])
def test_conversations_round_trip(spark, part_chars):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "a\nb\\|<|", "x" * 100), (3, 0, "a\nb\\|<|", "x" * 100), (None, 5, "user", "hi"), (4, None, "assistant", "é<\\|")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in queries.read_formatted(chat_template.format_conversations(df, part_chars=part_chars)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or ""))
        said = [(x[2] or "", x[3] or "") for x in own]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        loss = "".join(b for a, b in said if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_template.format_conversations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- edit matching


def brute_least(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(500):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, 14))) for lo in (1, 0))
        assert edit_match.least_distance(edit_match.masks(item), len(item), text)[0] == brute_least(item, text)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = rng.choice("xyz")
            case 1:
                del out[at]
            case _:
                out.insert(at, rng.choice("xyz"))
    return "".join(out)


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 16)))) for k in range(8)] + [(8, None), (9, "?!"), (10, "short")]
    docs = [(0, None), (1, ""), (2, "nothing of it")]
    for k in range(40):
        item = items[rng.randrange(8)][1]
        docs.append((10 + k, f"{rng.random()} {edited(rng, item, rng.randrange(6))}, And {rng.random()}"))
    docs += [(60, items[0][1].upper().replace(" ", "\n")), (60, items[0][1].upper().replace(" ", "\n")), (None, items[1][1]), (61, f"x short. {items[2][1]}")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    want = Counter()
    for doc, text in docs:
        for item, passage in items:
            p, t = edit_match.plain(passage), edit_match.plain(text)
            if p and t:
                k, _ = edit_match.pieces_of(p)
                d = brute_least(p, t)
                if d <= k:
                    want[doc, item, d] += 1
    for block in (edit_match.BLOCK_CHARS, 100):
        got = Counter((r.doc_id, r.item_id, r.distance) for r in edit_match.find_matches(documents(spark, docs), bench, block_chars=block).collect())
        assert got == want
    kept = edit_match.decontaminate(documents(spark, docs), bench)
    hit = {doc for doc, _, _ in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(doc for doc, _ in docs if doc not in hit)
    assert edit_match.find_matches(documents(spark, docs), bench.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_encoder_equals_tokenizer():
    rng = random.Random(9)
    bits = ["a", "The", "é", "12", " ", " ", " ", "\n", "\t", ".", "<|endoftext|>", "'s", "世", "_", "\x1c", "\r\n", " ", "​", "tion"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encode = packing.Encoder(TOKENIZER)
    assert encode(texts) == encode.by_file(texts)


def test_plan_fills_sequences():
    rng = random.Random(10)
    for spread in (1024, 300, 900, 40):
        counts = [0] * 1025
        for _ in range(3000):
            counts[rng.randint(1, spread)] += 1
        filled = defaultdict(list)
        seen = Counter()
        for length, rank, n, first, offset in packing.plan_packing(counts):
            assert rank == seen[length]
            seen[length] += n
            for k in range(n):
                filled[first + k].append((offset, length))
        assert [seen[n] for n in range(1025)] == counts
        for own in filled.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
            assert sum(length > 341 for _, length in own) <= 2
        total = sum(n * c for n, c in enumerate(counts))
        large = sum(counts[513:])
        assert len(filled) <= 1.08 * max(-(-total // 1024), large) + 1


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(documents(spark), TOKENIZER, with_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    ids = dict(corpus())
    for doc in (10, 70, 71, 80, 82):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        want = [*tokenizer.encode(ids[doc] or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r.ids] == want
        assert all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert packing.pack_documents(documents(spark, []), TOKENIZER).count() == 0


# ---------------------------------------------------------------- WARC


def test_chunked_round_trip():
    for text in ("", "a", "é" * 50, "x" * 1000, "😀\r\n0\r\n\r\n" * 20):
        for size in (1, 3, 7, 64):
            assert warc.dechunk(warc.chunked(text, size).encode()) == text.encode()


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_warc_round_trip(spark, tmp_path, broadcast):
    long = "<p>é WARC/1.1\r\n\r\n</p>" * 500
    rows = [(1, "http://a/ b\r\n", "x"), (2, "http://b", "x"), (5, None, "x"), (3, "u", None), (4, "u", ""), (None, "v", long), (6, "w", long), (7, "q", long + "1"), (8, "r", long + "2"), (8, "r", long + "2"), (9, "s", "one")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    path = str(tmp_path / f"warc{broadcast}")
    warc.write_warc(df, path, segment_bytes=700, chunk_bytes=100, broadcast_digests=broadcast)
    got = Counter(tuple(r)[1:3] + (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_warc(spark, path, broadcast_records=broadcast).collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        want["response" if page == top else "revisit", page, len(data), warc.digest32(data), None if page == top else top] += 1
    assert got == want


def test_broken_segments_are_refused(spark):
    rows = [("o", 1, None, "response", 1, "u", None, None, b"HTTP/1.1 200 OK\r\n\r\nab"), ("o", 2, 99, "continuation", None, None, None, None, b"c")]
    with pytest.raises(Exception, match="22 bytes of 99"):
        warc.reassemble(spark.createDataFrame(rows, warc.SEGMENTS)).collect()


def test_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    leak, passage = text(40), text(60)
    clean = [(k, text(120)) for k in range(30)]
    near = clean[0][1].split()
    near[60] = "changed"
    rows = [*clean, (40, clean[0][1]), (41, " ".join(near)), (42, f"{text(70)} {leak} {text(30)}"), (43, f"{text(80)} {passage} {text(20)}"), (44, f"{text(80)} {passage} {text(20)}"), (45, "too short"), (46, "$$$ %%% ### " * 60)]
    documents(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {k for k, _ in clean} | {43, 44}
    encode = packing.Encoder(TOKENIZER)
    lost = dict(rows)[44].replace(passage, " ")
    sizes = Counter()
    for r in out:
        sizes[r.doc_id] += r.length
    assert sizes[44] == len(encode([" ".join(lost.split())])[0]) // 4 + 1
    assert sizes[43] == len(encode([dict(rows)[43]])[0]) // 4 + 1


def test_stages_return_documents_columns(spark, tmp_path):
    docs = documents(spark, clash=False)
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_warc_members(spark, tmp_path):
    """Files of one member for all records, of one for each, of several with padding, and plain ones are read in full."""
    page = lambda k: (k, f"http://h/{k}", f"<p>text {k} \u00e9</p>" * (1 + 40 * k))
    records = [[(r + warc.END).encode() for r in warc.page_records(*page(k), None, "2020-01-01T00:00:00Z", 500, 100)] for k in range(12)]
    flat = [r for page_of in records for r in page_of]
    assert len(flat) > 24
    files = {"one": gzip.compress(b"".join(flat[:9])), "each": b"".join(map(gzip.compress, flat[9:17])), "plain": b"".join(flat[17:20]),
             "some": gzip.compress(b"".join(flat[20:23])) + bytes(5) + b"".join(map(gzip.compress, flat[23:])) + bytes(3)}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    assert warc.read_segments(spark, str(tmp_path / "in")).count() == len(flat)
    got = {r.page_id: r.payload_bytes for r in warc.read_warc(spark, str(tmp_path / "in")).collect()}
    assert got == {k: len(page(k)[2].encode()) for k in range(12)}
    for cut in (files["each"][:-6], files["each"] + b"rest"):
        with pytest.raises(ValueError):
            warc.unpacked(cut)


def test_warc_is_written_in_members(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * k) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "out"), records_per_file=20)
    found = 0
    for f in (tmp_path / "out").glob("part-*"):
        data, at = f.read_bytes(), 0
        while at < len(data):
            member = zlib.decompressobj(31)
            record = member.decompress(data[at:])
            at = len(data) - len(member.unused_data)
            assert member.eof and record.startswith(b"WARC/1.1") and record.endswith(b"\r\n\r\n")
            found += 1
    assert found == 30


def test_warc_large_records():
    """A record beyond one member's length is several members."""
    data = warc.packed("y" * (20 << 20)) + b"\0"
    assert warc.unpacked(data) == b"y" * (20 << 20) + b"\r\n\r\n"


def test_deep_pages_take_linear_time():
    began = time.time()
    for html in ("<div>" * 100_000 + "deep", "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<ul><li>" * 50_000 + "</b>" * 100_000 + "end"):
        page = html_model.Page(html)
        assert page.text([True] * len(page.tag)) in ("deep", "", "end")
    assert time.time() - began < 30


def test_repeated_pieces_take_linear_time():
    item = "the quick brown fox jumps over the lazy dog and then runs away from the big bad wolf"
    matcher = edit_match.Matcher([(1, item)], 25)
    piece = matcher.items[0][3][0][1]
    began = time.time()
    assert matcher.hits(piece * 100_000) == []
    assert matcher.hits(piece * 1000 + item)[0][1] == 0
    assert time.time() - began < 30


@pytest.mark.parametrize("source", ["{{ 'a' * 300000000 }}", "{{ 1 + 'a' }}", "{{ '%1000000000d' % 5 }}", "{{ 9 % 0 }}", "{{ 5 | length }}", "{{ " + " * ".join(["9" * 900] * 9) + " }}"])
def test_templates_are_bounded(source):
    with pytest.raises(chat_template.TemplateError):
        chat_template.fold(chat_template.parse(source))


def test_braces_in_literals():
    tree = chat_template.fold(chat_template.parse("""{{ 'a}}b' }}{% set x = "%}" %}{{ x }}"""))
    assert tree[0] == chat_template.Text("a}}b")


def test_the_encoder_is_proved(tmp_path):
    assert packing.agrees(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as f:
        data = json.load(f)
    merges = data["model"]["merges"]
    k = next(i for i, m in enumerate(merges) if m == ["t", "he"] or m == "t he" or i == 300)
    merges[k], merges[k + 1] = merges[k + 1], merges[k]
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps(data))
    assert not packing.agrees(str(odd))
    texts = ["the other thing", "", "a  b\n\nc 12 \u00e9"]
    assert packing.Encoder(str(odd), by_rank=False)(texts) == packing.Encoder(str(odd)).by_file(texts)


def test_pieces_hold_the_tokenizers_ids(spark):
    """Every piece of every text against the tokenizer itself, and the places against the rules of packing."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [(k, t) for k, (_, t) in enumerate(corpus())]
    want = {}
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, len(ids)] if len(ids) <= 1024 else [0, *range(first, len(ids) + 1, 1024)]
        for n, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[k, n] = (a, z - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:z])))
    found = packing.pack_documents(documents(spark, rows), TOKENIZER).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= 1.1 * -(-sum(r.length for r in found) // 1024) + 1


@pytest.mark.parametrize("piece", ['<a ">"', "<p '>", '<a b="', "<![CDATA[ ", "<br '\">"])
def test_unclosed_quotes_take_linear_time(piece):
    began = time.perf_counter()
    html_model.Page(piece * 50_000)
    assert time.perf_counter() - began < 10


def test_tags_end_outside_of_quotes():
    page = html_model.Page("<p title='a > b'>one</p><p title=\"x>two</p><![CDATA[ gone ]]><p>three")
    assert page.text([True] * len(page.tag)) == "one two three"
