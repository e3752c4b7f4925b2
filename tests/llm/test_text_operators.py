"""Secret scans, repeated passages, toxicity, encoding and page texts against brute force and on odd rows."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import html_text, pieces, secrets, substring, toxicity

DOC = "doc_id long, text string, vec string, hash long, row string"  # with names that operators use inside


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)


ODD = [(None, None), (None, ""), (1, None), (2, ""), (2, ""), (3, " \n\t "), (4, "word " * 20_000)]


# secret scans


def test_base_spans_by_brute_force(spark):
    rnd = random.Random(3)
    bits = ["password=", "secret: ", "Token", "api-key", "apikey", '"', "=", " ", ":", "AKIA", "ABCDEFGH1234", "abcdef0123456789", "deadbeef" * 4, "x", "\n", "é"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randint(0, 30)))) for i in range(300)]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    for i, text in rows:
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for *_, k in found) for x in ("assign", "access", "hex"))
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_weak_parts_need_their_complements():
    secret = "Zx9Qw8Er7Ty6Ui5Op4As3D"
    whole = f"username: alice {secret} https://api.example.org/v1"
    assert "linked_secret" in secrets.scan_text(whole)[4]
    for part in (f"username: alice {secret}", f"{secret} https://api.example.org/v1", secret, f"username: alice\n\n{secret}\n\nhttps://api.example.org"):
        assert secrets.scan_text(part)[4] == ""
    assert secret not in secrets.scan_text(whole)[5] and "alice" in secrets.scan_text(whole)[5]


def test_secrets_of_odd_rows(spark):
    got = secrets.scan_secrets(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan_secrets(docs(spark, [])).count() == 0
    assert secrets.redact_documents(docs(spark, ODD)).where("text IS NULL").count() == 2


# repeated passages


def removed(rows):
    first = {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i, w in split.items():
        for at in range(len(w) - 12):
            key = tuple(w[at : at + 13])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split.items():
        gone = {at + k for at in range(len(w) - 12) if first[tuple(w[at : at + 13])] < i for k in range(13)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substring_dedup_by_brute_force(spark):
    rnd = random.Random(5)
    passages = [[f"{rnd.choice('abcde')}{rnd.randint(0, 40)}" for _ in range(n)] for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [str(rnd.random()) for _ in range(rnd.randint(0, 9))]
        rows.append((i, rnd.choice([" ", "\n", "\t \r"]).join(words)))
    got = substring.remove_repeats(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows)


def test_substring_dedup_of_odd_rows(spark):
    got = substring.remove_repeats(docs(spark, ODD + [(5, "word " * 30)])).collect()
    assert len(got) == len(ODD) + 1
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got if r.n_words} == {(4, 20_000, 0), (5, 30, 30)}
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_every_pair_of_windows_shares_an_anchor():
    for i, j in product(range(substring.PERIOD), repeat=2):
        assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER for d in range(substring.PERIOD))


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_by_brute_force():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("abominable", True)]
    automaton = toxicity.Automaton(terms)
    rnd = random.Random(7)
    for _ in range(3000):
        w = list(rnd.choice(terms)[0])
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "t", "s"])
        w = "".join(w)
        best = []
        for t, (term, stem) in enumerate(terms):
            d = min(distance(w[:n], term) for n in range(len(w) + 1)) if stem else distance(w, term)
            if d <= toxicity.allowed(term, stem):
                best.append(d)
        hit = automaton.match(w)
        assert (hit[0] if hit else None) == (min(best) if best else None), w


def test_toxicity_on_held_out_documents(spark, labelled):
    sf_dir = labelled
    all_docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_model(all_docs, labels)
    rows = toxicity.score_documents(all_docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    kept = toxicity.keep_clean(all_docs, model)
    assert kept.columns == all_docs.columns and 0.8 * all_docs.count() < kept.count() < all_docs.count()


def test_toxicity_without_labels_and_of_odd_rows(spark):
    own = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(own, toxicity.train_model(own, none)).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)


def test_quoted_hits_count_less():
    scanner = toxicity.Scanner([("idiot", False)])
    assert scanner.features('it was "an idiot thing" there')[0] < scanner.features("it was an idiot thing there")[0] < scanner.features("you are an idiot there")[0]


# encoding


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


TEXTS = ["", " ", "Hello  world", "a▁b ▁", "naïve café — 東京 🙂", "line\nbreak\n\n", "x" * 300, "tab\tand\r\n", "word " * 500]


def test_encoding_is_lossless_and_varies():
    own = pieces.Codec(pieces.MODEL_PATH, 0.3, 1, 4)
    plain = pieces.Codec(pieces.MODEL_PATH, 0.0)
    for t in TEXTS:
        for key in range(5):
            assert own.decode(own.encode(t, key).tolist()) == t
        assert plain.decode(plain.encode(t).tolist()) == t
    long = "The quick brown fox jumps over the lazy dog. " * 5
    assert len({tuple(own.encode(long, k).tolist()) for k in range(10)}) > 5
    assert (own.encode(long, 3) == pieces.Codec(pieces.MODEL_PATH, 0.3, 1, 4).encode(long, 3)).all()


def test_agendas_side_by_side_equal_one_by_one():
    own = pieces.Codec(pieces.MODEL_PATH, 0.2, 9, 3)
    chunks = ["▁understanding", "▁tokenization", "▁a", "▁naïve", "東京", "▁" + "ab" * 30, "xyz"]
    for v in range(3):
        for c, packed in zip(chunks, own._segment_many(chunks, [v] * len(chunks))):
            assert packed == pieces.array(own.code, own._segment(c, v)).tobytes()


def test_without_dropout_the_pieces_are_the_models(model):
    own = pieces.Codec(pieces.MODEL_PATH, 0.0)
    for t in ("Hello world, this is a simple sentence.", "understanding tokenization"):
        assert "".join(own.pieces[i] for i in own.encode(t)) == "▁" + t.replace(" ", "▁")
        assert own.encode(t).tolist() == model.encode(t)


def test_encoding_of_odd_rows(spark):
    own = docs(spark, ODD + list(enumerate(TEXTS, 10)))
    coded = pieces.encode_documents(own)
    got = coded.collect()
    assert all(r.lossless for r in got) and sum(r.ids is None for r in got) == 2
    back = sorted(r.text for r in pieces.decode_documents(coded).collect() if r.text is not None)
    assert back == sorted(t for _, t in ODD + list(enumerate(TEXTS)) if t is not None)
    assert pieces.encode_documents(docs(spark, [])).count() == 0


# page texts


def test_main_text():
    body = "<p>First &amp; foremost, a long\n  paragraph of text.</p><p>Second one.</p>"
    page = f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1>{body}</article><div id=comments><p>I disagree, and at length, dear reader.</p></div><footer>c</footer></body></html>"
    assert html_text.main_text(page) == "Head\nFirst & foremost, a long paragraph of text.\nSecond one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text(page.replace("article", "div")) .startswith("Head")


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>" + "long text " * 50_000, "x"), (2, "u", "<p>a", "x"), (2, "u", "<p>a", "x")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 499_999]
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).select(F.max("n_chars")).first()[0] is None


LONG = [f"Paragraph {i} of the article, which goes on for a good while and says what there is to say about it." for i in range(8)]


def paragraphs(part):
    return "".join(f"<p>{p}</p>" for p in part)


def test_boxes_inside_an_unmarked_article_leave_no_gap():
    box = "<div class='ad'>" + "<p>Buy this now</p>" * 5 + "</div><form>" + "<div>Your name</div>" * 4 + "</form>"
    links = "<ul>" + "<li><a href='/x'>Some other page of this site</a></li>" * 12 + "</ul>"
    for tag in ("div", "article"):
        page = f"<body>{links}<{tag}>{paragraphs(LONG[:3])}{box}{paragraphs(LONG[3:])}</{tag}>{links}</body>"
        got = html_text.main_text(page).split("\n")
        assert [t for t in got if t in LONG] == LONG and not any("Buy" in t or "name" in t for t in got)
        assert sum("other page" in t for t in got) <= 2


@pytest.mark.parametrize("name", ["layout has-sidebar", "with-comments", "sidebar", "widget"])
def test_an_article_in_a_wrapper_named_after_its_surroundings_is_found(name):
    page = f"<body><div class='{name}'><nav>Home</nav><article>{paragraphs(LONG)}</article></div><div class=comments><article class=comment><p>No.</p></article></div></body>"
    assert html_text.main_text(page) == "\n".join(LONG)


def test_marks_on_titles_and_teasers_do_not_silence_the_rest():
    titled = f"<body><h1 class='main-title'>Head</h1><div>{paragraphs(LONG)}</div></body>"
    assert html_text.main_text(titled) == "\n".join(["Head", *LONG])
    cards = "<article><h3><a href='/y'>Other</a></h3><p>Teaser.</p></article>" * 3
    assert html_text.main_text(f"<body><div>{paragraphs(LONG)}</div>{cards}</body>").split("\n")[: len(LONG)] == LONG
    aside = f"<body><article>{paragraphs(LONG)}</article><aside>{cards}</aside></body>"
    assert html_text.main_text(aside) == "\n".join(LONG)


@pytest.mark.parametrize(
    "text, secret",
    [
        ("user=bob\npassword=hunt3r2\nhttps://db.internal", "hunt3r2"),
        ("user=bob, see the manual\npwd=Summer2024! on host=db.example.com", "Summer2024!"),
        ("login: bob then pass: x1 at https://example.org", "x1"),
        ('DB_HOST=db.example.com\nDB_USER=bob\nDB_PASS="a b c"', "a b c"),
        ("client_id=shop\nid 550e8400-e29b-41d4-a716-446655440000 https://api.example.org", "550e8400-e29b-41d4-a716-446655440000"),
        ("account: shop JBSWY3DPEHPK3PXPJBSWY3DP 10.0.0.1:8080", "JBSWY3DPEHPK3PXPJBSWY3DP"),
        ("user=bob password=hunt3r2", "hunt3r2"),
        ('{"password": "hunt3r2", "username": "bob"}', "hunt3r2"),
        ("DB_PASSWORD=hunt3r2\nDB_USER=bob", "hunt3r2"),
    ],
)
def test_weak_secrets_with_their_complements(text, secret):
    spans, redacted = secrets.scan_text(text)[4:]
    found = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in spans.split(",") if x) if k == "linked_secret"]
    assert found == [secret] and secret not in redacted and "linked_id" in spans


@pytest.mark.parametrize(
    "text",
    [
        "password=hunt3r2",
        "password=hunt3r2 https://db.internal",
        "user=bob, as the manual has it, and password=hunt3r2",
        "user=bob\n\npassword=hunt3r2",
        "user=bob https://example.org release-notes-of-the-version-2024-01",
        "client_id=550e8400-e29b-41d4-a716-446655440000 https://api.example.org",
        "user=bob host=db.example.com",
    ],
)
def test_weak_secrets_without_their_complements(text):
    assert secrets.scan_text(text)[4] == ""


def test_every_occurrence_draws_its_own_skips():
    own = pieces.Codec(pieces.MODEL_PATH, 0.1, 11)
    word = " understanding"
    forms = [tuple(own.encode_many([word[1:]], [k])[0].tolist()) for k in range(4000)]
    assert len(set(forms)) > 8
    # as often whole as independent draws leave it: no candidate that comes up is skipped
    plain, came = own._segment_counted(word.replace(" ", pieces.SPACE), 0)
    whole = sum(f == tuple(plain) for f in forms) / len(forms)
    by_chance = random.Random(1)
    want = 0
    for _ in range(4000):
        want += own._segment(word.replace(" ", pieces.SPACE), sum(1 << n for n in range(99) if by_chance.random() < 0.1)) == plain
    assert came > 2 and abs(whole - want / 4000) < 0.04 and whole > 0.9**came - 0.04
    # places of one text vary too, and what is remembered changes nothing
    text = word * 300
    one = own.encode(text, 7).tolist()
    assert one == pieces.Codec(pieces.MODEL_PATH, 0.1, 11).encode(text, 7).tolist() and own.decode(one) == text
    assert one != own.encode(text, 8).tolist()


def test_copies_of_a_document_differ(spark):
    text = "The quick brown fox jumps over the lazy dog, understandingly. " * 20
    rows = spark.createDataFrame([(1, text)] * 6 + [(None, text)] * 2, "doc_id long, text string")
    got = pieces.encode_copies(rows).collect()
    assert len(got) == 8 and all(r.lossless for r in got) and len({tuple(r.ids) for r in got}) == 8
    assert {tuple(r.ids) for r in pieces.encode_copies(rows.repartition(3)).collect()} == {tuple(r.ids) for r in got}


def plain_pieces(own, text, key, copy_key=0):
    """One agenda for each chunk, read from its rules: the best candidate first, leftmost of equals, each skipped by its own draw."""
    out = []
    for place, chunk in enumerate(own._chunks(text)[0] if text else []):
        if place in own._chunks(text)[1]:
            out += [own.bytes[b] for b in chunk.encode()]
            continue
        named = key & (1 << 64) - 1
        named = (named ^ named >> 32) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        name = ((named ^ named >> 29) + place * 0xA0761D6478BD642F) & (1 << 64) - 1
        draw = lambda turn: int(own._draw(np.array([name], np.uint64), turn)[0])
        symbols, gone, came, turn = list(chunk), set(), 0, 1
        skip = draw(0)
        while True:
            starts = [sum(map(len, symbols[:i])) for i in range(len(symbols))]
            some = [(-own.scores[a + b], starts[i], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in own.scores and (starts[i], a, b) not in gone]
            if not some:
                break
            _, start, i = min(some)
            if came == skip:
                gone.add((start, symbols[i], symbols[i + 1]))
                skip, turn = skip + 1 + draw(turn), turn + 1
            else:
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            came += 1
        for s in symbols:
            out += [own.ids[s]] if s in own.ids else [own.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_merge_dropout_by_brute_force(dropout, labelled, spark):
    own = pieces.Codec(pieces.MODEL_PATH, dropout, 5)
    rnd = random.Random(3)
    texts = [t for t in TEXTS if len(t) < 400] + [r.text[:600] for r in spark.read.parquet(f"{labelled}/documents.parquet").where("text IS NOT NULL").limit(30).collect()]
    texts += ["".join(rnd.choices(["understand", "ing", " ", "x", "東", "a▁", "é", "supercalifragilistic", "zq"], k=30)) for _ in range(20)]
    keys = list(range(7, 7 + len(texts)))
    for t, k, got in zip(texts, keys, own.encode_many(texts, keys)):
        assert got.tolist() == plain_pieces(own, t, k), t
        assert own.decode(got.tolist()) == t


def test_what_is_remembered_changes_nothing(monkeypatch):
    texts = [" ".join(random.Random(i).choices(["understanding", "tokenization", "naïve", "東京", "of", "the", "x" * 50], k=400)) for i in range(6)]
    want = [x.tolist() for x in pieces.Codec(pieces.MODEL_PATH, 0.2, 5).encode_many(texts, list(range(6)))]
    monkeypatch.setattr(pieces, "MEMORY", 3)
    monkeypatch.setattr(pieces, "CHUNKS", 64)
    own = pieces.Codec(pieces.MODEL_PATH, 0.2, 5)
    assert [own.encode(t, k).tolist() for k, t in enumerate(texts)] == want


def test_a_very_long_word_takes_one_pass():
    import time

    own = pieces.Codec(pieces.MODEL_PATH, 0.1, 5)
    start = time.process_time()
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    assert own.decode(own.encode(text).tolist()) == text and time.process_time() - start < 30
