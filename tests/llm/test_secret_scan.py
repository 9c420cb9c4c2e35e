"""Base patterns against a plain reading of the contract; the lexer on source and configuration files."""

import hashlib
import random
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from cases import TEXTS

from tracewright.llm import secret_scan as S

FILES = {
    'DB_PASS = "corr3ctHorseBattery9"': ["corr3ctHorseBattery9"],
    'prefix = "sk_live_9a8B7c"\napi_secret = prefix + "6D5e4F3g2H1"': ["sk_live_9a8B7c", "6D5e4F3g2H1"],
    'prefix="sk_live_9a8B7c"\napi_secret=prefix+"6D5e4F3g2H1"': ["sk_live_9a8B7c", "6D5e4F3g2H1"],
    "k = 'Zx81kQ0vP2mN7bL4'\nclient = Client(api_key=k, timeout=30)": ["Zx81kQ0vP2mN7bL4"],
    'dbPassword: str = "Sup3rS3cretValue!"': ["Sup3rS3cretValue!"],
    '{"auth": {"client_secret": "aB3dE5fG7hJ9kL1m"}}': ["aB3dE5fG7hJ9kL1m"],
    "export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzzzKEY9": ["wJalrXUtnFEMIK7MDENGbPxRfiCYzzzKEY9"],
    "- name: API_TOKEN\n  value: q8W7e6R5t4Y3u2I1": ["q8W7e6R5t4Y3u2I1"],
    '<add key="StripeSecretKey" value="rk_9x8y7z6w5v4u3t2s"/>': ["rk_9x8y7z6w5v4u3t2s"],
    "<password>Tr0ub4dor&3xyz</password>": ["Tr0ub4dor&3xyz"],
    "curl --password hunter2hunter2 https://bob:p4ssW0rd99x@host/x": ["hunter2hunter2", "p4ssW0rd99x"],
    "setenv('APP_TOKEN', 'tok_55aa66bb77cc');": ["tok_55aa66bb77cc"],
    'secretKey = `k3y-${part}-0099aaBB`; part = "Qq1Ww2Ee3"': ["k3y-", "-0099aaBB", "Qq1Ww2Ee3"],
    'a = b = my_token = "Zz9Yy8Xx7Ww6"': ["Zz9Yy8Xx7Ww6"],
    'my_token = a = b = "Zz9Yy8Xx7Ww6"': ["Zz9Yy8Xx7Ww6"],
    'api_key = """\nZx81kQ0vP2mN7bL4"""': ["\nZx81kQ0vP2mN7bL4"],
    "password_length = '12345678901234'": [],
    "the secret: forgotten gardens": [],
    'password = "changeme123456"': [],
    'token = os.getenv("TOKEN")': [],
    "a = b\nb = a\nmy_token = a": [],
    "title = 'Zx81kQ0vP2mN7bL4'": [],
    "l'eau d'un secret, qu'on dit: rien": [],
    "": [],
}


@pytest.mark.parametrize("text", list(FILES))
def test_lexer(text):
    assert [text[s:e] for s, e, _, _ in sorted(S.Lexer(text).secrets())] == FILES[text]


def plain(text):
    """Base spans by the contract's words."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for i, (kind, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)], 1):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x for _, _, x in sorted(out)]


def noise(rng):
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "API_KEY", " ", "  ", "=", ":", '"', "'", "AKIA", "AKIA" + "Q1" * 6, "é", "ſ", "K", "\n", "a1b2c3d4", "0123456789abcdef" * 2, "Zz9+/_.=-", "x", "\\", "${a}", "a", "--", "<", ">", "value", "name", "://u:", "@", ",", "+", "`", '"""', "日本"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def test_base_against_the_contract_and_spans_stay(spark):
    rng = random.Random(11)
    texts = [t for _, t in TEXTS] + list(FILES) + [noise(rng) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in S.digests(S.find_secrets(docs)).collect()}
    assert len(found) == len(texts)
    for i, t in rows:
        base, r = plain(t or ""), found[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        every = r["spans"].split(",") if r["spans"] else []
        assert [x for x in every if not x.startswith("literal")] == base
        assert every == [f"{s['kind']}:{s['start']}:{s['end']}" for s in S.scan(t or "")]  # the search in columns leaves none out
        starts = [int(x.split(":")[1]) for x in every]
        assert starts == sorted(starts)
    assert sum(r["spans"].count("literal") for r in found.values()) > 30


def test_texts_without_what_they_must_hold_have_no_spans():
    rng = random.Random(5)
    texts = [noise(rng) for _ in range(20000)]
    may = pc.match_substring_regex(pa.array(texts), S.MAY_HOLD).to_pylist()
    assert not [t for t, m in zip(texts, may, strict=True) if not m and S.scan(t)]


@pytest.mark.parametrize("unit", ["password=", "token = '", "a=b+", '"' + "\\'", 'x="a""', "<secret>", "f(a, 'b', ", "t: u\n", "--token ", "https://a:", "'''", "a=`"])
def test_time_grows_with_the_text(unit):
    def taken(n):
        began = time.perf_counter()
        S.scan(unit * n + "\nsecret = a\n" * (n // 10))
        return time.perf_counter() - began

    taken(100)
    assert taken(40_000) < 8 * taken(10_000) + 0.5


def test_rows_that_need_care(spark):
    rows = [(1, None, "x"), (1, 'api_key = "Zx81kQ0vP2mN7bL4"', "y"), (1, 'api_key = "Zx81kQ0vP2mN7bL4"', "y"), (None, "token = abcdefgh12", "z"), (2, "w " * 300_000 + 'pwd = "Zx81kQ0vP2mN7bL4"', None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = sorted((r["doc_id"], r["spans"]) for r in S.digests(S.find_secrets(docs)).collect())
    assert found == [(1, ""), (1, "assign:0:27,literal:11:27"), (1, "assign:0:27,literal:11:27"), (2, "literal:600007:600023")]
    assert S.digests(S.find_secrets(docs.where("false"))).count() == 0
    cut = S.redact(docs)
    assert cut.columns == docs.columns
    assert sorted(str(r["text"])[-16:] for r in cut.collect()) == sorted(["None", '[secret]"', '[secret]"', "[secret]", 'w pwd = "[secret]"'[-16:]])
