"""Every operator against a brute-force version, on a fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm import bpe, html_text, jaccard_join, language_id, licenses, line_dedup, media, queries, secrets
from stowage.llm.components import components
from stowage.llm.line_dedup import mark

LOW = {i: i + 32 for i in range(65, 91)}
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = [None, "", " \n\t ", "word", "a b c", "12 34 !", "é è  ê\r\nx\x1cy z w", "\0lead <|endoftext|> it's 's  \n\n x"]
    base = words(200)
    for i in range(40):  # near copies, some within and some beyond the bound
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(200)] = rng.choice(vocab)
        out.append(" ".join(w))
    out += ["The same line here.\n" + " ".join(words(60)) + "\n  the SAME line here. " for _ in range(12)]
    out += [" ".join(base).upper()] * 5 + ["a b c"] * 3
    out.append(" ".join(words(30_000)))
    out += [" ".join(words(n)) for n in (4, 5, 6, 7, 300, 301)]
    out += ["Released under the MIT License. CC BY-NC 4.0 cc by", "gnu general public license, GNU General Public License", "apache license"]
    out += ['password = "hunter22" token: ' + "ab" * 20 + " AKIA" + "Q" * 16, "token=tok secret=x password:abcdefgh"]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts = corpus()
    rows = [(i * 3 % 1009, t, "en" if t and i % 2 else None, "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(str(d / "documents.parquet"))
    html = [None, "", "plain <b>text", "<nav>menu</nav><article><h1>T &amp; x</h1><p>one<br>two<p>three</article><footer>f</footer>"]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip([None, "http://a/1", "http://a/2", "http://a/3"], html, strict=True))], "page_id long, url string, html string").write.parquet(str(d / "pages.parquet"))
    return str(d), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SHAPE).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(d / "pages.parquet"))
    return str(d)


def run(spark, name, d):
    return queries.queries()[name](spark, d).toPandas()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_table(spark, nothing, name):
    assert len(run(spark, name, nothing)) == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(spark, folder):
    d, docs = folder
    got = run(spark, "op1_jaccard_join", d)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == {i: (len(shingles(t)), least) for (i, t), least in zip(docs.items(), groups_of(docs).values(), strict=True)}


def test_need_is_exact():
    """No link is lost by the bound: every linked pair shares `need` first tokens, at sizes around the fixed range."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, int(rng.integers(0, 6)), dtype=np.uint64)]))
        if jaccard_join.linked(a, b):
            (x, far), (y, far2) = (jaccard_join.firsts(s, np.zeros(0, np.uint64)) for s in (a, b))
            slack = [len(x) - len(a), len(y) - len(b)]
            need = max(1, -(-3 * (len(a) + len(b)) // 7) + (min(slack) if far or far2 else max(slack)))
            assert len(np.intersect1d(x, y)) >= need


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_components_of_many_tasks(spark, monkeypatch):
    """Forests of a few edges each, so that trees meet between them; an end of the rounds is an error."""
    from stowage.llm import components as C

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (7, 7)]
    least = {i: i for e in edges if None not in e for i in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b and a is not None:
                least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    monkeypatch.setattr(C, "_contracted", lambda e: e.repartition(3))  # without forests the rounds alone must do
    assert {r.id: r.label for r in C.components(frame).collect()} == least
    with pytest.raises(RuntimeError):
        C.components(frame, rounds=1)
    monkeypatch.undo()
    assert {r.id: r.label for r in C.components(frame).collect()} == least
    a, b = C.forest(*map(np.array, zip(*[e for e in edges if None not in e], strict=True)))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {i: x for i, x in least.items() if x != i}


def keys(text):
    return [line.strip(" \t\n\x0b\x0c\r").translate(LOW) for line in (text or "").split("\n")]


def test_lines(spark, folder):
    d, docs = folder
    n = Counter(k for t in docs.values() for k in set(keys(t)))
    for r in run(spark, "op2_line_dedup", d).itertuples():
        lines = (docs[r.doc_id] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(docs[r.doc_id]), strict=True) if not (k and n[k] >= 10)]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_lines_joined_and_first(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    for keep in ("none", "first"):
        a, b = (sorted(map(tuple, mark(docs, 10, 1, keep, broadcast_keys=n).collect())) for n in (1000, 0))
        assert a == b
    assert sum(r[3] for r in a) > 0


def test_packing(spark, folder):
    d, docs = folder
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs.items()}
    got = run(spark, "op3_packing", d).sort_values(["sequence_id", "offset"])
    at = 0
    for r in got.itertuples():
        assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at += r.length
    assert at == sum(map(len, ids.values()))
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}


def test_byte_bpe(spark, folder):
    d, docs = folder
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in run(spark, "op4_byte_bpe", d).itertuples():
        text = docs[r.doc_id] or ""
        ids = np.array(own.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


PARTS = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "é", "ß", "中文", " the", " и", "'s", "'", "1", "23", ".", ",", "<|endoftext|>", "<|", "\0", "hello", " World", "😀", "½", "\x85", "x" * 30, "'ll"]


@pytest.mark.parametrize("cache", [40, bpe.CACHE])
def test_tokens_of_any_strings(cache):
    """Strings of every kind of character, with a memory that is always full and with one that never is."""
    from stowage.llm import packing

    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>", "a   b", "a\n\n\n  b\n "] + ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    path, ranks = P.path("byte_bpe_50k.json"), bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    whole, rank = Tokenizer.from_file(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one, two = packing._codec.__wrapped__(path, P.PATTERN), bpe.Codec(ranks, P.PATTERN)
    for codec, ids_of in ((one, lambda t: whole.encode(t, add_special_tokens=False).ids), (two, rank.encode_ordinary)):
        codec.encode.__self__.cache = cache
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            ids, off = codec.encode(pa.array(["skipped", *part]).slice(1))
            for i, t in enumerate(part):
                assert ids[off[i] : off[i + 1]].tolist() == ids_of(t or "")
            if codec is two:
                data, ends = codec.decode(ids, off)
                assert [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] == [(t or "").encode() for t in part]


def test_language(spark, folder):
    d, docs = folder
    got = run(spark, "op5_language_id", d)
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id] or ""))
    real = run(spark, "op5_language_id", "/root/testdata/sf0.001").set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    held = real[real.held_out]
    assert (held.lang_pred == labels[held.index]).mean() >= 0.97
    assert language_id.Model([], np.zeros((0, 4)), np.zeros(0)).predict(["text"]) == (["und"], [0.0])


def der(*parts, tag=0x30):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secrets(spark, folder):
    d, docs = folder
    for r in run(spark, "op6_secret_scan", d).itertuples():
        t = docs[r.doc_id] or ""
        found = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I) if len(m[2]) >= 6]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
    number = der(bytes(range(1, 60)), tag=2)
    key = der(der(b"\0", tag=2), *[number] * 8)
    kinds = lambda t: [k for k, _, _ in secrets.spans_of(t)[1]]
    b64 = base64.b64encode(key).decode()
    assert kinds(f"x {b64} y") == ["der"] and "der" in kinds(key.hex()) and kinds(b64[:-8]) == []
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END RSA PRIVATE KEY-----")[:1] == ["der"]
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    assert kinds(token) == ["jwt"] and kinds(token.replace("e", "f", 1)) == []
    assert secrets.masked("a token=abcdefg b", secrets.spans_of("a token=abcdefg b")[1]) == "a <secret> b"


def test_fingerprints(spark, folder):
    d, docs = folder
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    got = run(spark, "op7_fingerprint", d).set_index("doc_id")
    assert set(got.index) == set(docs) and len(got) == len(docs)
    for i, t in docs.items():
        t = t or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + (docs[after[i]] or "")[:k]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got.near_next[i] <= 1 and (edited != t or got.near_edited[i] == 1)
    by = {}
    for i, t in docs.items():
        by.setdefault(t or "", set()).add(got.fingerprint[i])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_media(spark, folder):
    d, docs = folder
    got = run(spark, "op8_media", d)
    assert len(got) == len(docs)
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.width, r.height, r.bits) == (576, len(data) // 576, 8)
    assert got.groupby("payload_sha256")[["feature", "media_sha256"]].nunique().max().max() == 1


def test_licenses(spark, folder):
    d, docs = folder
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in run(spark, "op9_license_scan", d).itertuples():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[r.doc_id] or "").translate(LOW))
        at = [(i, v) for p, v in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
        assert not at or (r.first_word, r.last_word) == (min(at)[0], max(at)[0])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_in_a_row(spark):
    """Whole phrases close to each other, whose diagonals chain."""
    texts = ["mozilla public license mozilla public license", "cc by nc " * 50, "bsd 3 clause license bsd 3 clause license", "cc by, cc by-sa, cc by-nc, cc by-nd", "mozilla public x mozilla public y", None]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mpl", 1.0), 1: ("cc-by,cc-by-nc", 1.0), 2: ("bsd", 1.0), 3: ("cc-by,cc-by-nc,cc-by-sa", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def test_html(spark, folder):
    d, _ = folder
    got = run(spark, "op10_html_extraction", d).set_index("page_id").text
    assert got.to_dict() == {0: "", 1: "", 2: "plain text", 3: "T & x\n\none two\n\nthree"}
    page = '<body><header>H</header><div class="sidebar">S</div><div class="cookie-notice">N</div><main><h1>T</h1><p>a&nbsp; b</p><aside>x</aside><form>q</form><script>1<2</script><p>c</p><section class="comments"><article class="comment">no</article></section></main><div id="footer">F</div></body>'
    assert html_text.main_text(page, {}) == "T\n\na b\n\nc"


def _pages(spark, pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")


def test_html_template_inside_articles(spark):
    """A block on all pages of a host goes, though its class is on no list and it stands in the article; copies keep their text."""
    pages = [("http://a/x", f'<article><h1>Title {i}</h1><p>own {i}</p><div class="xq">Follow us</div></article>') for i in range(5)]
    pages += [("http://b/x", "<main><p>the same</p><p>text</p></main>")] * 5
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, pages)).collect()}
    assert got == {i: f"Title {i}\n\nown {i}" if i < 5 else "the same\n\ntext" for i in range(10)}


def test_html_names_and_depth():
    text = lambda h, known=None: html_text.main_text(h, known)
    assert text('<article><p>a</p><p data-id="footer">keep me</p><p data-class=ad>b</p></article>') == "a\n\nkeep me\n\nb"
    assert text('<article><section class="related-work"><p>kept</p></section><div class="related-posts">x</div><div class="site-footer">x</div><p>b</p></article>') == "kept\n\nb"
    page = '<article><h2 class="search">On search</h2><p>b</p></article>'
    tag = next(t.digest for t in html_text.parse(page) if t.doubt >= 0)
    other = {1: (-9, 1, True)}
    assert text(page, other) == "On search\n\nb" and text(page, {tag: (-9, tag, True), **other}) == "b" == text(page)
    assert text('<div class="content"><p>short</p></div><p>' + "most of the text " * 9 + "</p>").startswith("short\n\nmost")
    deep = "<div>" * 100_000 + "x" + "</div>" * 100_000 + "<p><ul>" * 20_000 + "<h1>" * 20_000 + "y"
    assert text(deep) == "x\n\ny"


def test_html_classes_are_those_of_brute_force(spark):
    """Tokens, occurrence vectors and classes of small hosts against dictionaries, repeated and id-less pages too."""
    rng = random.Random(3)
    blocks = ["<div class=m><a>Home</a></div>", "<p>same</p>", "<ul><li>x<li>y</ul>", "<p>other</p><p>other</p>", '<div id="n7">n</div>']
    pages = [(f"http://h{i % 3}/p", "<body>" + "".join(b for b in blocks if rng.random() < 0.7) + f"<p>own {i % 11}</p></body>") for i in range(40)]
    frame = spark.createDataFrame([(None if i % 4 else 1, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    vectors = {}
    for i, (u, h) in enumerate(pages):
        for (token, tag), n in Counter((t.digest, not t.text) for t in html_text.parse(h)).items():
            vectors.setdefault((u[7:9], token, tag), set()).add((i, n))
    classes = {}
    for (host, token, tag), v in vectors.items():
        if len(v) >= html_text.SUPPORT:
            classes.setdefault((host, frozenset(v)), []).append((token, tag))
    want = set()
    for (host, v), tokens in classes.items():
        sure = any(tag for _, tag in tokens) or 2 * len(v) >= sum(u[7:9] == host for u, _ in pages)
        if sure or len(tokens) >= html_text.SIZE:
            want |= {(host, t, len(v), min(tokens)[0], sure) for t, _ in tokens}
    got = {(r.host, r.token, r.pages, r.first, r.sure) for r in html_text.deduced(frame).collect()}
    assert got == want and len({x[3] for x in want}) > 6


def test_html_classes_decide(spark):
    """What the classes find is not in the text; without them it would be."""
    pages = [("http://a/x", f'<article><h1>T {i}</h1><p>own text {i}</p><div>Read our terms</div></article>') for i in range(6)]
    got = [r.text for r in html_text.extract(_pages(spark, pages)).collect()]
    assert "terms" not in "".join(got) and all("terms" in html_text.main_text(h, {}) for _, h in pages)


def test_html_near_copies_of_an_article_keep_it(spark):
    """Four of five pages share most of an article, one with another title and one with an own end."""
    body = "".join(f"<p>shared paragraph {k}</p>" for k in range(6))
    pages = [("http://a/x", f"<article><h1>{'Other' if i == 2 else 'Title'}</h1>{body}{'<p>end</p>' if i == 1 else ''}</article>") for i in range(4)] + [("http://a/x", "<article><h1>Z</h1><p>z</p></article>")]
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, pages)).collect()}
    shared = "\n\n".join(f"shared paragraph {k}" for k in range(6))
    assert got == {0: f"Title\n\n{shared}", 1: f"Title\n\n{shared}\n\nend", 2: f"Other\n\n{shared}", 3: f"Title\n\n{shared}", 4: "Z\n\nz"}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_html_layouts_of_one_host(spark, limit):
    """Three layouts, a third of the pages each: unnamed menus go, a repeated sentence and an article's copies stay."""
    menus = ["<div><b>Home A</b></div><div>Shop A</div>", '<div class="q1"><p>News B</p></div>', "<ul><li>Home C<li>Contact C</ul>"]
    pages = [("http://a/x", f"<body>{menus[i % 3]}<p>own {i}</p>{'<p>often said</p>' if i % 5 == 0 else ''}</body>") for i in range(30)]
    pages += [("http://a/x", f"<article><p>{'copied' if i < 34 else i}</p><p>{'text' if i < 34 else -i}</p><p>own {i}</p></article>") for i in range(30, 40)]
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, pages), limit).collect()}
    assert got == {i: f"own {i}" + "\n\noften said" * (i % 5 == 0) if i < 30 else f"copied\n\ntext\n\nown {i}" if i < 34 else f"{i}\n\n{-i}\n\nown {i}" for i in range(40)}


def groups_of(texts):
    """The least id of each id's component of texts that link, by all pairs."""
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def masked_plainly(text):
    """Every character of a plain secret's span marked, and each run of marked spans that overlap replaced."""
    spans = [m.span() for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", text, re.A | re.I)]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", text)] + [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "<secret>"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark, folder):
    """Each stage against a brute-force version of it on what the stage before kept."""
    import corpus_pipeline as pipe

    d, docs = folder
    frame, texts = spark.read.parquet(f"{d}/documents.parquet"), docs
    for name, stage in pipe.STAGES[:-1]:
        frame = stage(spark, frame, d)
        rows = frame.collect()
        now = {r.doc_id: r.text for r in rows}
        assert frame.columns == SHAPE.replace(" long", "").replace(" string", "").split(", ") and all(r.n_chars == len(r.text) for r in rows)
        if name == "language_id":
            assert now == {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
        if name == "line_dedup":
            n = Counter(k for t in texts.values() for k in set(keys(t)) if k)
            assert now == {i: "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if n[k] < 10) for i, t in texts.items()} != texts
        if name == "near_duplicates":
            assert now == {i: texts[i] for i, least in groups_of(texts).items() if i == least} and len(now) < len(texts)
        if name == "secrets":
            assert now == {i: masked_plainly(t) for i, t in texts.items()} != texts
        texts = now
    got = pipe.STAGES[-1][1](spark, frame, d).toPandas().sort_values(["sequence_id", "offset"])
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}
    assert (got.length.cumsum() - got.length == got.sequence_id * 2048 + got.offset).all() and got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got.itertuples())


def test_language_scores_are_those_of_brute_force(spark):
    """Counts, log probabilities and scores of a fit on three languages, n-gram by n-gram in plain Python."""
    rng = random.Random(2)
    parts = {"a": ["the", "of", "and", "wh"], "b": ["der", "ung", "ß", "ich"], "c": ["é", "que", "ou", "les"]}
    texts = [(lang, " ".join("".join(rng.choices(parts[lang if rng.random() < 0.8 else "a"], k=2)) for _ in range(rng.randint(1, 40))) + "! 12") for lang in "aabbc" for _ in range(8)]
    model = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string"))

    def grams(text):
        c = re.sub(r" +", " ", " " + "".join(x if x.isalpha() else " " for x in text.lower()) + " ")
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = n
                for x in c[i : i + n]:
                    h = (h ^ ord(x)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                yield h >> 49

    counts = {x: Counter(g for lang, t in texts if lang == x for g in grams(t)) for x in "abc"}
    asked = [t for _, t in texts] + ["é", "zz unknown 7", "and der que"]
    langs, scores = model.predict(asked)
    for t, lang, score in zip(asked, langs, scores, strict=True):
        total = {x: math.log(sum(y == x for y, _ in texts) / len(texts)) + sum(math.log((counts[x][g] + 0.5) / (counts[x].total() + 0.5 * 2**15)) for g in grams(t)) for x in "abc"}
        best = max(sorted(total), key=total.get)
        assert lang == best and abs(score - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-9


def test_fit_bounds_rows_not_ids(spark):
    docs = spark.createDataFrame([(1, "one", "a")] * 30 + [(i, "two", "b") for i in range(2, 12)], "doc_id long, text string, lang string")
    assert language_id.fit(docs, rows=10).languages == ["b"] and language_id.fit(docs, rows=40).languages == ["a", "b"]


def test_key_structures():
    """Keys of each encoding are reported, and cut or lengthened ones are not."""
    point, oid = der(bytes(range(32)), tag=4), der(b"\x2a\x86\x48\xce\x3d", tag=6)
    kinds = {
        "pkcs8": (der(der(b"\0", tag=2), der(oid), der(bytes(range(70)), tag=4)), "der"),
        "sec1": (der(der(b"\1", tag=2), point, der(oid, tag=0xA0)), "der"),
        "openssh": (b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + bytes(30), "openssh"),
    }
    for raw, kind in kinds.values():
        b64 = base64.b64encode(raw).decode()
        spans = secrets.spans_of(f"key {b64} end")[1]
        assert (kind, 4, 4 + len(b64)) in spans
        assert secrets.key_kind(raw[:20]) is None and (kind == "openssh" or secrets.key_kind(raw + b"x") is None)
    assert secrets.key_kind(der(oid, point)) is None and secrets.key_kind(b"") is None
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"RSA-OAEP","enc":"A128GCM"}', b"any")) + ".x"
    assert [k for k, _, _ in secrets.spans_of(token)[1]] == ["jwt"] and [k for k, _, _ in secrets.spans_of(token.replace(".", "..", 1))[1]] == []


def test_likeness_is_the_share_of_common_leaves():
    """The tree's likeness against multisets of leaves, and differences at the edited place."""
    from stowage.llm import fingerprint

    rng = random.Random(8)
    lines = [" ".join(rng.choices("red blue green one two. three! four".split(), k=rng.randint(0, 30))) for _ in range(30)]
    leaves = lambda t: Counter(x for line in t.split("\n") if line.strip() for x in fingerprint._leaves(line))
    for _ in range(200):
        a, b = ("\n".join(rng.choices(lines, k=rng.randint(0, 12))) for _ in range(2))
        x, y = leaves(a), leaves(b)
        want = 1.0 if a == b else 0.0 if not x or not y else (x & y).total() / max(x.total(), y.total())
        assert fingerprint.likeness(fingerprint.tree(a), fingerprint.tree(b)) == want
    text = [f"paragraph number {i} of this text" for i in range(20)]
    a, b = (fingerprint.tree("\n".join(t)) for t in (text, [*text[:7], "an edited one", *text[8:]]))
    places = fingerprint.differences(a, b)
    assert len(places) == 1 and [p for s in a.split("/")[1:] for p in s.split(":")].index(a.split("/")[1 + places[0][0]].split(":")[places[0][1]]) == 7


@pytest.mark.parametrize("n", [0, 1, 2, 5, 24, 25, 26])
def test_ranges_of_ids(spark, n):
    from stowage.llm.fingerprint import _ranges

    cuts = list(range(-6, 3 * n - 6, 3))
    got = spark.range(-12, 80).select("id", _ranges(F.col("id"), cuts).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) for r in got)


def test_features_of_payloads():
    for data in (bytes([255]) * 576, bytes(range(256)) * 9, b"abc" * 384, random.Random(1).randbytes(576 * 3)):
        cut = [i * len(data) // 65 for i in range(66)]
        means = [sum(data[a:b]) / max(1, b - a) for a, b in zip(cut, cut[1:], strict=False)]
        bits = "".join("1" if y > x else "0" for x, y in zip(means, means[1:], strict=False))
        mean = sum(data) / len(data)
        dev = math.sqrt(max(0.0, sum(x * x for x in data) / len(data) - mean * mean))
        assert media.feature(data) == f"{int(bits, 2):016x}:{int(mean * 100)}:{int(dev * 100)}"


def test_filters_merge_over_many_tasks(spark):
    """More tasks than one merge takes: the filter is that of all documents in one task."""
    docs = spark.createDataFrame([(i, f"line {i % 40}\nother {i}") for i in range(120)], "doc_id long, text string")
    one, many = (line_dedup.twice_filter(docs.repartition(n, "doc_id"), bits=16, segment=12, fan=3) for n in (1, 11))
    assert one == many and sum(map(int.bit_count, one)) >= 40


def test_license_notices_against_brute_force(spark):
    """Notices with words put in and left out: labels and scores by every pair of words, diagonal and span in plain Python."""
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words = "intro text".split()
        for _, _, phrase, _ in rng.choices(licenses.NOTICES[6:], k=rng.randint(1, 2)):
            keep = rng.choice([1.0, 0.9, 0.75, 0.6])
            words += [x for w in phrase.split() if rng.random() < keep for x in ([w, "junk"] if rng.random() < 0.05 else [w])] + ["and", "more"]
        texts.append(" ".join(words))
    got = {r.doc_id: (r.labels, r.score, r.n_base) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, t in enumerate(texts):
        w, labels, cover = t.split(), set(), 0.0
        for p, label in licenses.BASE.items():
            labels |= {label} if f" {p} " in f" {t} " else set()
        for _, label, phrase, share in licenses.NOTICES:
            q = phrase.split()
            hits = sorted((a - b, a, b) for a in range(len(w) - 1) for b in range(len(q) - 1) if w[a : a + 2] == q[b : b + 2])
            runs: list[list] = []
            for h in hits:
                if not runs or h[0] - runs[-1][-1][0] > licenses.NEAR:
                    runs.append([])
                runs[-1].append(h)
            steps = len(q) - 1
            for run_ in runs:
                for _, a, _ in run_:
                    c = len({b for _, x, b in run_ if a <= x < a + 2 * steps})
                    if c >= share * steps:
                        labels.add(label)
                        cover = max(cover, c / steps)
        found += bool(cover)
        assert got[i][0] == ",".join(sorted(labels)) and abs(got[i][1] - (1.0 if got[i][2] else cover)) < 1e-12
    assert 10 < found < 60


@pytest.mark.parametrize("batch", [["x", "a" * 24], ["", "f" * 24, None, "z " + "0" * 24], ["q", "0" * 24 + " z", "tail"], ["a" * 23, "b" * 23], [""], [None, "c" * 24 + "\n" + "d" * 23]])
def test_runs_at_a_texts_ends(batch):
    for text, long_ in zip(batch, secrets.long_runs(pa.array(batch, pa.string())), strict=True):
        assert secrets.spans_of(text or "", bool(long_)) == secrets.spans_of(text or "")


def test_no_letter_is_no_language():
    counts = np.ones((1, 1 << language_id.BUCKET_BITS))
    model = language_id.Model(["en"], counts, np.ones(1))
    assert model.predict(["½ ² ٣ _ 12", "é", "", None])[0] == ["und", "en", "und", "und"]


CLASH = ("n", "digest", "row", "bucket", "part", "lang_pred", "score", "fingerprint", "n_lines", "n_dropped", "component_id", "label", "key", "first", "h")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows without an id, of one id, null and empty texts, and columns named like the operators' own."""
    d = tmp_path_factory.mktemp("odd")
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, text), (None, text), (100, text), (200, text + " more"), (300, None), (300, "")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    spark.createDataFrame([(i, t, "en" if i else None, None, None, *CLASH) for i, t in rows], shape).write.parquet(str(d / "documents.parquet"))
    pages = [(None, None, "<p>x</p>", "c", "c"), (1, "http://a/b", None, "c", "c"), (1, "http://a/b", None, "c", "c")]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, classes string").write.parquet(str(d / "pages.parquet"))
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_rows(spark, odd, name):
    got = run(spark, name, odd)
    assert len(got) == (3 if name.startswith("op10") else 6)
    if name.startswith("op1_"):
        assert sorted(map(tuple, got.dropna()[["doc_id", "component_id"]].astype(int).values.tolist())) == [(100, 100), (200, 100), (300, 300), (300, 300)]
        assert got[got.doc_id.isna()].component_id.isna().all() and (got[got.doc_id.isna()].n_shingles == 8).all()


def test_many_repeated_lines_of_rows_without_an_id(spark):
    """The join for more keys than are broadcast gives the broadcast's rows, rows without an id too."""
    docs = spark.createDataFrame([(i if i % 3 else None, f"again\nown {i}") for i in range(12)] + [(7, "own 1"), (None, None)], "doc_id long, text string")
    for keep in ("none", "first"):
        got = [sorted(map(repr, line_dedup.mark(docs, 10, 1, keep, broadcast_keys=n).collect())) for n in (1_000_000, 0)]
        assert got[0] == got[1]


def test_an_id_of_two_texts(spark):
    """Only one of document 7's texts is a copy; the other one still links."""
    x, y = "one two three four five six seven eight nine ten eleven twelve", "red orange yellow green blue indigo violet black white grey brown pink"
    docs = spark.createDataFrame([(3, x), (7, x), (7, y), (9, y + " more")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.similar_groups(docs).collect()} == {3}


def test_odd_pipeline(spark, odd):
    import corpus_pipeline as pipe

    frame = spark.read.parquet(f"{odd}/documents.parquet")
    columns = frame.columns
    for _, stage in pipe.STAGES[:-1]:
        frame = stage(spark, frame, odd)
        assert frame.columns == columns and all(r.n_lines == "n_lines" and r.score == "score" for r in frame.collect())
    assert len(pipe.STAGES[-1][1](spark, frame, odd).collect()) == 3


def test_all_ids_null(spark):
    from stowage.llm.fingerprint import with_next

    docs = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string")
    assert [(r.text, r.ghost) for r in with_next(docs).collect()] == [("a", False), ("b", False), ("a", True)]
