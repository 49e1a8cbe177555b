import base64
import bz2
import gzip
import hashlib
import random
import re
import textwrap
import urllib.parse
import zlib

import zstandard
from pyspark.sql import functions as F

from tidemark.llm import queries, secrets

KEY = "password=hunter2hunter2"


def test_base_kinds():
    text = f'x API-key: no apikey = "ABCDEFGH" AKIA{"A1" * 6} AKIASHORT token:short SECRET: "longenough_1" {"0f" * 16} {"0f" * 15} Token="{"a0" * 16}"'
    got = [(k, text[a:b]) for k, via, a, b in secrets.find(text)]
    assert got == [
        ("assign", 'apikey = "ABCDEFGH'), ("access", "AKIA" + "A1" * 6), ("assign", 'SECRET: "longenough_1'), ("hex", "0f" * 16),
        ("assign", 'Token="' + "a0" * 16), ("hex", "a0" * 16),
    ]
    assert secrets.find("pa\u017f\u017fword=hunter2hunter2 to\u212aen=hunter2hunter2") == []


def test_layers_map_to_the_original():
    b64 = lambda x: base64.b64encode(x).decode()
    inner = KEY.encode()
    codings = [
        b64(inner), b64(gzip.compress(inner)), b64(zlib.compress(inner)), b64(bz2.compress(inner)), b64(zstandard.compress(inner)), b64(b64(inner).encode()),
        urllib.parse.quote(b64(gzip.compress(inner))), "".join(f"%{c:02X}" for c in inner), "".join(f"\\u{c:04x}" for c in inner), "".join(f"\\x{c:02x}" for c in inner),
        b64("".join(f"%{c:02X}" for c in inner).encode()), "%25".join(["", *[f"{c:02x}" for c in inner]]), b64(gzip.compress(b64(gzip.compress(inner)).encode())),
    ]
    for code in codings:
        text = f"été {code} end"
        spans = secrets.find(text)
        assert spans, code
        for kind, via, a, b in spans:
            assert kind == "assign" and via and 4 <= a < b <= 4 + len(code)
        assert KEY not in secrets.redacted_text(text) and secrets.redacted_text(text).startswith("été ")


def test_cycles_bombs_and_clean_texts():
    assert secrets.find("%2525252525 \\u005cu005c 100% sure") == []
    assert secrets.find("") == [] and secrets.redacted_text("plain text") == "plain text"
    bomb = base64.b64encode(zlib.compress(b"a" * ((64 << 20) + 10))).decode()
    assert secrets.find(bomb) == [("hex", "base64+zlib", 0, len(bomb))]
    long = "lorem ipsum " * 50_000 + KEY
    assert secrets.find(long) == [("assign", "", len(long) - len(KEY), len(long))]


def brute(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 8)
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for *_, x in sorted(out)]


def test_query_over_nulls_and_repeats(spark, tmp_path):
    rows = [(1, None, ""), (2, "", ""), (3, f"é {KEY} {'ab' * 20}", ""), (3, f"é {KEY} {'ab' * 20}", ""), (None, "AKIA" + "B" * 12, "")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op7_secrets(spark, str(tmp_path)).collect():
        want = brute(next(t for i, t, _ in rows if i == r.doc_id) or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.spans == ",".join(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in want) for k in secrets.KINDS)
    df = spark.createDataFrame([(None,), (KEY,)], "t string").select(secrets.redact(F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == [None, "[REDACTED]"]


def test_base64_in_any_place_and_form():
    b64 = lambda x: base64.b64encode(x).decode()
    rnd = random.Random(2)
    pad = "".join(f"line {rnd.random()}\n" for _ in range(40)).encode()
    inner = KEY.encode()
    cases = {f"{prefix}{b64(inner)}": inner for prefix in ("https://x.org/f/", "id-", "a_", "xx", "abcdefghij/klmnopq/")}
    cases |= {f"{prefix}{b64(pack(pad + inner))}": None for prefix in ("https://x.org/f/", "id-", "xyz") for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.compress)}
    cases |= {base64.encodebytes(pack(pad + inner + pad)).decode().strip(): None for pack in (bytes, gzip.compress, zlib.compress, bz2.compress, zstandard.compress)}
    for at in range(40, 76):  # the secret lies across the end of a line
        cases["\r\n".join(textwrap.wrap(b64(b"-" * at + inner + b"." * 60), 76))] = None
    cases |= {b64(raw): None for raw in (b"\0" * 5 + inner, b"\xff\xfe" + KEY.encode("utf-16-le"), KEY.encode("utf-16"), KEY.encode("utf-16-be"), b"\x01" + inner + b"\x02\xe9")}
    cases |= {b64(pack(b"hello ") + pack(b"pass") + pack(b"word=hunter2hunter2")): None for pack in (gzip.compress, zlib.compress, bz2.compress, zstandard.compress)}
    for code in cases:
        text = f"\u00e9t\u00e9 {code}"
        spans = [s for s in secrets.find(text) if s[0] == "assign"]
        assert spans and all(4 <= a < b <= len(text) for *_, a, b in spans), code
        assert any(b - a >= 4 * len(KEY) // 3 for *_, a, b in spans), code
        assert not secrets.find(secrets.redacted_text(text)), code
    text = f"id-{b64(inner)} tail"
    assert secrets.find(text) == [("assign", "base64", 3, 3 + len(b64(inner)) - 1)]


def test_more_escapes():
    forms = {
        "entity": ["".join(f"&#{ord(c)};" for c in KEY), "".join(f"&#x{ord(c):X};" for c in KEY), "password=&quot;hunter2hunter2&quot;"],
        "url": ["".join(f"%u{ord(c):04x}" for c in KEY), "".join(f"%u{ord(c):04x}" if c == "p" else f"%{ord(c):02x}" for c in KEY)],
        "escape": ["".join(f"\\U{ord(c):08x}" for c in KEY), "".join(f"\\u{{{ord(c):x}}}" for c in KEY)],
    }
    for via, codes in forms.items():
        for code in codes:
            got = secrets.find(f"x {code} y")
            assert [(k, v) for k, v, *_ in got] == [("assign", via)] and 2 <= got[0][2] < got[0][3] <= 2 + len(code), code
    assert secrets.find("\\ud83d\\ude00 %ud83d &unknown; &#99999999; &#xFFFFFF; \\UFFFFFFFF") == []


def test_deep_and_large_layers(monkeypatch):
    """Layers of any depth and size are read, as streams of overlapping windows."""
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16)
    monkeypatch.setattr(secrets, "CARRY", 1 << 15)
    inner = KEY.encode()
    deep = inner
    for _ in range(60):
        deep = gzip.compress(deep)
    assert [k for k, *_ in secrets.find(base64.b64encode(deep).decode())] == ["assign"]
    rnd = random.Random(5)
    noise = "".join(f"line {rnd.random()}\n" for _ in range(8000)).encode()  # in several windows
    assert len(noise) > 2 * secrets.WINDOW
    for content in (noise + inner + noise[:1000], gzip.compress(noise + inner), bz2.compress(noise) + bz2.compress(inner), noise[: secrets.WINDOW - 7] + inner + noise):
        code = base64.b64encode(zlib.compress(content, 1)).decode()
        assert [(k, a, b) for k, _, a, b in secrets.find(f"id {code}")] == [("assign", 3, 3 + len(code))]
    for lead in range(0, 1 << 16, 9000):  # a coded block in a window's middle or over its end
        far = noise[:lead] + base64.b64encode(zlib.compress(noise[:20_000] + inner, 1)) + b"\n" + noise
        assert [k for k, *_ in secrets.find(base64.b64encode(gzip.compress(far, 1)).decode())] == ["assign"]


def test_random_nestings_against_their_encoder():
    """Passwords wrapped in random codings, in random surroundings, are all found, and none in the same texts without them."""
    rnd = random.Random(17)
    codings = [
        lambda b: base64.b64encode(b), lambda b: base64.urlsafe_b64encode(b), lambda b: base64.b64encode(gzip.compress(b)), lambda b: base64.b64encode(zlib.compress(b)),
        lambda b: base64.b64encode(bz2.compress(b)), lambda b: base64.b64encode(zstandard.compress(b)), lambda b: "".join(f"%{c:02x}" for c in b).encode(),
        lambda b: "".join(f"\\u{c:04x}" for c in b).encode(), lambda b: "".join(f"&#{c};" for c in b).encode(), lambda b: base64.encodebytes(b).strip(),
    ]
    for _ in range(120):
        plan, place = [rnd.choice(codings) for _ in range(rnd.randint(1, 3))], rnd.choice([b"", b"some words, ", "été ".encode(), b"\0\xff"])
        texts = []
        for value in (KEY.encode(), b"nothing to be seen here"):
            code = place + value + b" end"
            for f in plan:
                code = f(code)
            texts.append(f"lead: {code.decode()}\n tail")
        found = ["assign" in [k for k, *_ in secrets.find(t)] for t in texts]
        assert found == [True, False], texts[0][:200]
        assert not secrets.find(secrets.redacted_text(texts[0]))


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, found string, n_assign long, via string"
    spark.createDataFrame([(1, KEY, "f", 9, "v"), (1, KEY, "f", 9, "v")], schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert [(r.doc_id, r.n_assign) for r in queries.op7_secrets(spark, str(tmp_path / "a")).collect()] == [(1, 1)] * 2
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert queries.op7_secrets(spark, str(tmp_path / "b")).count() == 0


WORDS = KEY.encode() + b" and more words to compress, words to compress"


def deflated(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def test_compressed_bytes_wherever_they_are_written():
    """As percent codes, quoted or in full, and as escapes of several languages; the span is the whole run."""
    for packed in (gzip.compress(WORDS), zlib.compress(WORDS), bz2.compress(WORDS)):
        codes = [urllib.parse.quote(packed), urllib.parse.quote_plus(packed), "".join(f"%{c:02x}" for c in packed)]
        codes += [repr(packed)[2:-1], "".join(f"\\x{c:02x}" for c in packed)] if packed[:1] != b"B" else [repr(packed)[2:-1]]
        for code in codes:
            text = f'été "{code}" end' if "'" in code else f"été '{code}' end"
            spans = secrets.find(text)
            assert len(spans) == 1 and spans[0][0] == "assign" and text.index(code) - 1 <= spans[0][2] < spans[0][3] <= text.index(code) + len(code) + 1, code


def test_broken_narrow_and_headless_base64():
    b = base64.b64encode(WORDS).decode()
    for code in (f"{b[:40]}\\n{b[40:80]}\\n{b[80:]}", f"{b[:40]}\\r\\n{b[40:80]}\\r\\n{b[80:]}", "\n".join(textwrap.wrap(b, 12)), "word\nabcd\n" + "\n".join(textwrap.wrap(b, 8)), base64.b64encode(deflated(WORDS)).decode()):
        assert [k for k, *_ in secrets.find(f"lead {code} tail")] == ["assign"], code
    assert secrets.find("pass\\167ord = hunter2hunter2")[0][1:] == ("escape", 0, 28) and secrets.find("x password+%3D+hunter2hunter2")[0][1:] == ("form", 2, 29)


def test_every_secret_of_a_block_is_listed():
    packed = base64.b64encode(gzip.compress(b"password=hunter2hunter2 token=abcdefgh12345678 password=hunter2hunter2")).decode()
    text = f"a {packed} b"
    assert [(k, a, b) for k, _, a, b in secrets.find(text)] == [("assign", 2, 2 + len(packed))] * 2
    assert secrets.redacted_text(text) == "a [REDACTED] b"


def test_clean_texts_with_codes_stay_clean():
    for text in ("100% of it \\n done \\t C:\\new\\table", "a+b%20c+d", "\\x1f\\x8b\\x08 broken " * 50, "x\\x9c" * 500, "one\ntwo\nsix\nten\n" * 50, base64.b64encode(bytes(range(256)) * 8).decode()):
        assert secrets.find(text) == []
