"""Operators on single texts: pieces, token counts, media, pages, personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import bpe_count, gif, html_text, pii, sentencepiece
from sparkloom.llm.queries import tokenizer_path


def noise(seed, n, most=40):
    r = random.Random(seed)

    def char():
        k = r.random()
        if k < 0.5:
            return r.choice("abthe ing,.\n 12")
        return chr(r.choice([r.randrange(1, 0x250), r.randrange(0x300, 0xD7FF), r.randrange(0x10000, 0x2FFFF)]))

    return ["".join(char() for _ in range(r.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.load(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_the_library_with_the_same_scores(pieces):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = float(pieces["score"][i] * sentencepiece.UNIT)
    unigram = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t.replace(sentencepiece.MARK, "") for t in noise(1, 1500)] + ["", " ", "  a", "a  ", "x" * 700, "日本語" * 99]
    got = sentencepiece.encoder(pieces)(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [unigram.encode(t) for t in texts]


def test_pieces_round_trip(pieces):
    texts = noise(2, 2000) + ["▁", " ▁a ▁", "a▁▁b", ""]
    for text, raw in zip(texts, sentencepiece.encoder(pieces)(texts)):
        assert sentencepiece.decode(np.frombuffer(raw, "<i4"), pieces) == text


def test_double_array_finds_all_words_and_no_others():
    words = sorted({w.encode() for w in noise(3, 500, 6) if w})
    trie = sentencepiece.double_array(words, list(range(len(words))))

    def find(word):
        s = 0
        for b in word:
            t = int(trie["base"][s]) + b
            if t >= len(trie["check"]) or trie["check"][t] != s:
                return -1
            s = t
        return int(trie["value"][s])

    assert [find(w) for w in words] == list(range(len(words)))
    assert all(find(w + b"\xff") == -1 for w in words)


def test_encode_decode_rows(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = sentencepiece.encode_decode(docs, path).collect()
    assert len(rows) == docs.count()
    want = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(r.doc_id, r.decoded) for r in rows} == want
    assert all(r.n_pieces == len(r.piece_ids) for r in rows)
    assert [r.n_pieces for r in rows if r.doc_id in (3, 4)] == [0, 0]
    assert sentencepiece.encode_decode(empty, path).count() == 0


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = noise(4, 3000) + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "", "a" * 999, " " * 99, "\n\n x", "ab" * 500]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe_count.counter(bpe_count.load(path))(texts) == want
    rows = bpe_count.count_tokens(docs, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted(
        (r.doc_id or 0, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()
    )
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert bpe_count.count_tokens(empty, path).count() == 0


def test_gif_payload_round_trip():
    r = random.Random(5)
    for n in (0, 1, 63, 64, 65, 16384, 16385, 70000):
        for data in (r.randbytes(n), b"a" * n, bytes(r.choice(b"abc") for _ in range(n))):
            payload = gif.padded(data)
            assert len(payload) % 64 == 0 and payload and payload.startswith(data)
            got, frames = gif.read_text(gif.store_text(payload))
            assert got == payload and len(frames) == -(-len(payload) // 16384)


def by_hand(frames, disposal, clear):
    """A small GIF with transparency, written block by block."""
    out = [b"GIF89a", b"\x04\0\x02\0\xf7\0\0", gif.GREY]
    for index, (x, y), d, t in zip(frames, ((0, 0), (1, 0), (0, 1)), disposal, clear):
        flags = d << 2 | (t is not None)
        out += [b"!\xf9\x04", bytes([flags, 5, 0, t or 0]), b"\0,"]
        out.append(b"".join(v.to_bytes(2, "little") for v in (x, y, index.shape[1], index.shape[0])) + b"\0\x08")
        data = gif.lzw_pack(index.tobytes())
        out += [bytes([len(data)]), data, b"\0"]
    return b"".join([*out, b";"])


def test_gif_disposal_and_transparency():
    a = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.uint8)
    b = np.array([[9, 0]], np.uint8)
    c = np.array([[0, 20, 0, 30]], np.uint8)
    shown = [f.rgb[..., 0].tolist() for f in gif.decode(by_hand([a, b, c], (1, 2, 0), (None, 0, 0)))]
    assert shown[0] == a.tolist()
    assert shown[1] == [[1, 9, 3, 4], [5, 6, 7, 8]]  # 0 is transparent
    assert shown[2] == [[1, 0, 0, 4], [5, 20, 7, 30]]  # the second frame's area was cleared
    kept = [f.rgb[..., 0].tolist() for f in gif.decode(by_hand([a, b, c], (1, 3, 0), (None, 0, 0)))]
    assert kept[2] == [[1, 2, 3, 4], [5, 20, 7, 30]]  # what was before the second frame is put back
    assert [f.delay_ms for f in gif.decode(by_hand([a], (1,), (None,)))] == [50]


def test_gif_rows(spark, docs, empty):
    rows = gif.text_media(docs, keep_media=True)
    for r in rows.join(docs, "doc_id").select("doc_id", "text", "payload_sha256", "tail_crc32", "n_bytes", "payload_bytes").collect():
        payload = gif.padded((r.text or "").encode())
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.n_bytes, r.payload_bytes) == (len((r.text or "").encode()), len(payload))
    frames = gif.gif_frames(rows.where("doc_id = 6"), "doc_id").collect()
    assert len(frames) > 1 and all(sum(f.histogram) == f.rows * f.columns for f in frames)
    assert gif.gif_frames(spark.createDataFrame([(1, None), (2, bytearray(b"GIF89a"))], "id long, media binary"), "id").count() == 0
    assert gif.text_media(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li></ul></nav><div class="ad">Buy the best of all things in the world now.</div>
<article><h1>Heading &amp; more</h1><p>The first of the <b>para</b>graphs&nbsp;is
here.<p>Short.<br>Line<form>subscribe <input></form><aside>see also</aside>&lt;kept&gt;</article>
<section id="comments"><p>I think that the author is right in all of this and more.</p></section><footer>&copy; x</footer>"""


def test_pages(spark):
    text = html_text.main_text(PAGE)[0]
    assert text == "Heading & more The first of the paragraphs is here. Short. Line <kept>"
    good = "The cat of the house is in the garden and it was on the wall for a while with the dog. " * 4
    plain = f"<body><div><a href=/>Home</a> <a href=/b>News</a></div><h2>A heading</h2><p>{good}<p>It was short.<p>{good}<div>All rights</div>"
    got = html_text.main_text(plain)[0]
    assert got.count("The cat") == 8 and "It was short." in got and "Home" not in got and "rights" not in got
    rows = [(1, "u", PAGE), (2, None, None), (2, None, ""), (3, "v", "<" * 500), (4, "w", '<a "' * 500), (5, "x", "<p>" + "word " * 90000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n_chars", "'c' as text")
    out = html_text.extract(pages).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 2] == ["", ""]
    assert html_text.extract(pages.limit(0)).count() == 0


def brute_labels(found):
    """The two passes written out: every ambiguous block looks at all others."""
    first = [html_text.first_pass(b) for b in found]
    now = list(first)
    for inside in (True, False):
        new = list(now)
        for i, b in enumerate(found):
            if now[i] in ("good", "bad") or (b.region == 1) != inside:
                continue
            seen = [(abs(i - k), now[k]) for k, o in enumerate(found) if now[k] in ("good", "bad") and (not inside or o.region == 1)]
            if not inside:
                seen += [(d, "bad") for d, side in ((i + 1, range(i)), (len(found) - i, range(i + 1, len(found)))) if not any(now[k] in ("good", "bad") for k in side)]
            labels = {label for d, label in seen if d == min(seen)[0]}
            new[i] = "good" if not labels or labels == {"good"} else "bad" if labels == {"bad"} else "good" if inside or first[i] == "near" else "bad"
        now = new
    return now


def test_both_passes_equal_brute_force():
    import duckdb

    pages = [h for h, in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    cases = [html_text.blocks(p or "") for p in pages]
    r = random.Random(12)
    some = ["the cat is in the house " * 9, "the cat is in it", "Nouns verbs words", "junk " * 50, "the cat " * 2 + "words " * 12]
    for _ in range(3000):
        cases.append([])
        for _ in range(r.randrange(12)):
            text = r.choice(some)
            cases[-1].append(html_text.Block(text, r.choice([0, 0, 0, len(text)]), r.choice([None, None, 1, 1, -1])))
    seen = set()
    for found in cases:
        want = brute_labels(found)
        assert [b.label for b in html_text.classify(found)] == want
        seen |= {(b.region, html_text.first_pass(b), b.label) for b in found}
    assert len(seen) >= 11


def test_density_decides(monkeypatch):
    prose = "The cat of the house is in the garden and it was on the wall for a while with the dog. " * 4
    links = "".join(f"<li><a href=/{i}>Read topic number {i}</a></li>" for i in range(4))
    page = f"<article><h1>Title</h1><p>{prose}</p><ul>{links}</ul><p>{prose}</p></article>"
    got = html_text.main_text(page)[0]
    assert "topic" not in got and got.startswith("Title The cat") and got.count("The cat") == 8
    bare = f"<div><a><div>Some linked words</div></a><p>{prose}<p>Buy now: cheap shoes, best deals, free shipping, low prices, hot offers, new stock.<p>{'word ' * 60}</div>"
    assert html_text.main_text(bare)[0] == prose.strip()
    monkeypatch.setattr(html_text, "first_pass", lambda b: "bad" if b.region == -1 else "good")
    assert html_text.main_text(page)[0] != got and html_text.main_text(bare)[0] != prose.strip()


def test_linked_headlines_and_sentences_stay():
    prose = "The cat of the house is in the garden and it was on the wall for a while with the dog. " * 3
    page = f"<article><h2><a href=/x>Why the cat stays</a></h2><p>{prose}</p><p>See <a href=y>the full report of the house</a>.</p><p><a href=z>One linked line alone</a></p></article>"
    assert html_text.main_text(page)[0] == f"Why the cat stays {prose}See the full report of the house. One linked line alone"
    alone = "<article><h2><a href=/x>Only a linked headline</a></h2></article>"
    assert html_text.main_text(alone)[0] == "Only a linked headline"
    items = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(html_text.LIST_RUN))
    assert html_text.main_text(f"<article><p>{prose}</p><ul>{items}</ul></article>")[0] == prose.strip()


def test_pages_in_languages_without_stop_words():
    """Without marks of an article, length and links decide; menus and short lines around them go."""
    russian = "Кошка сидит на стене старого дома, а собака смотрит на неё из сада и долго лает, пока хозяин не выйдет. " * 4
    page = f"<body><div><a href=/>Главная</a> <a href=/n>Новости</a></div><p>{russian}</p><p>{russian}</p><div>Все права</div></body>"
    assert html_text.main_text(page)[0] == f"{russian}{russian}".strip()
    assert html_text.main_text(f'<body><div class="adslot-top">{russian}</div><p>{russian}</p></body>')[0] == russian.strip()
    listing = "".join(f"<li><a href=/{i}>Ещё одна длинная строка меню номер {i}, которая ведёт на другую страницу сайта</a></li>" for i in range(5))
    assert html_text.main_text(f"<body><ul>{listing}</ul></body>")[0] == ""


@pytest.mark.parametrize("tag", ["button", "svg", "select", "object", "script", "iframe", "textarea"])
def test_unclosed_elements_keep_the_rest_of_the_page(tag):
    prose = "The cat of the house is in the garden and it was on the wall for a while with the dog. " * 4
    got = html_text.main_text(f"<article><p>{prose}<{tag} x=y>Share<p>Second {prose}</article>")[0]
    assert got == f"{prose}Second {prose}".strip()
    got = html_text.main_text(f"<article><p>{prose}<{tag}>Share <p>in</p></{tag}><p>Second {prose}</article>")[0]
    assert got == f"{prose}Second {prose}".strip()


def test_names_of_classes():
    prose = "The cat of the house is in the garden and it was on the wall for a while with the dog."
    for name, stays in [("social-science", True), ("ad", False), ("share-buttons", False), ("siteFooter", False), ("legal-theory", True), ("cookie-banner-2", False)]:
        assert (html_text.main_text(f'<article><p>{prose * 4}<div class="{name}">Own {prose}</div></article>')[0].count("Own") == 1) == stays


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(6)
    texts = ["".join(r.choice("ab1234 .+-()@@_%") for _ in range(r.randrange(80))) for _ in range(4000)]
    texts += ["a@b.com.@x.y", "a@b.com_x@y.z", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "9" * 3000, "a" * 3000 + "@b.c"]
    for t in texts:
        assert pii.listed(pii.base_spans(t)) == brute_spans(t)


def test_pii_rows_and_added_spans(spark, docs, empty):
    rows = [(100 + i, f'log {i} password={i:02x}{"ab3f" * 5} done') for i in range(30)] + [(200 + i, f"plain {i} words {i * 37}") for i in range(30)]
    more = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    found = pii.find(more)
    texts = more.collect()
    assert found.count() == len(texts)
    by_id = {r.doc_id: r for r in found.collect()}
    for r in texts:
        base = brute_spans(r.text or "")
        assert by_id[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert by_id[r.doc_id].spans.startswith(base)
    assert all("secret" in by_id[100 + i].spans for i in range(30))
    assert all(by_id[200 + i].spans == "" for i in range(30))
    assert by_id[7].n_email == by_id[7].n_card == by_id[7].n_phone == by_id[7].n_ip == 1
    assert pii.find(empty).count() == 0


def test_redaction(spark, docs):
    assert pii.redact("call +12345678 or a@b.co", "email:18:24,phone:5:14") == "call <PHONE> or <EMAIL>"
    assert pii.redact("abcdef", "email:0:4,ip:2:5") == "<EMAIL>f"
    clean = pii.redact_all(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[7] == "Write to <EMAIL> or <PHONE>, card <CARD>, host <IP>." and got[3] is None
