import hashlib
import re

from regionspark.llm import secrets as m

CASES = [
    None, "", "nothing here", 'password = "hunter2x" and PASSWD:abc', "secret:pass", "password:token:abcdefgh", "token=abcdef1 API_KEY: 'A+/=_.-b'",
    "é日 apikey=ééé apikey=zzzzzz", "AKIA" + "A" * 16 + " AKIA12345", "xAKIA" + "B9" * 20, "0123456789abcdef01234567 0123456789abcdef0123456", "ABCDEF" * 5 + "f" * 24,
    "Key api_Key=abcdefgh toKen=abcdefgh", "paſſword=abcdefgh", "secret = deadbeefdeadbeefdeadbeef", "password\n=abcdefg password\t= abcdefg",
    "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefg", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----", "postgres://u:p@host",
]
BASE = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def brute(text):
    text, out = text or "", []
    for o, (kind, p) in enumerate(BASE.items()):
        for x in re.finditer(p, text):
            n = len(x[2]) if kind == "assign" else len(x[0])
            if n >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((x.start(), o, kind, x.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_and_added_spans(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(CASES * 2)] + [(0, "second row", "x", 3)], "doc_id long, text string, blob string, findings int").repartition(3)
    got = m.digest(m.BlobLedger(spark).scan(df, ["doc_id"], "text")).collect()
    assert len(got) == 2 * len(CASES) + 1
    added = set()
    for r in got:
        if r.doc_id == 0 and len(CASES):
            continue
        want = brute(CASES[r.doc_id % len(CASES)])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), CASES[r.doc_id % len(CASES)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in BASE]
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if x.split(":")[0] in BASE] == want
        added |= {x.split(":")[0] for x in spans} - set(BASE)
    assert added == {"jwt", "github", "pem", "url"}


def test_ledger_scans_only_unseen(spark):
    ledger = m.BlobLedger(spark)
    v = lambda rows: spark.createDataFrame(rows, "path string, version int, text string")
    one = v([("a", 1, "token=abcdefgh"), ("b", 1, "token=abcdefgh"), ("c", 1, None), (None, 1, "plain")])
    assert len(ledger.scan(one, ["path", "version"], "text").collect()) == 4
    assert ledger.read(m.RULE_VERSION).count() == 3
    two = v([("a", 1, "token=abcdefgh"), ("a", 2, "secret=zzzzzzzz"), ("d", 1, "plain")])
    got = {(r.path, r.version): len(r.findings) for r in ledger.scan(two, ["path", "version"], "text").collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("d", 1): 0}
    assert ledger.read(m.RULE_VERSION).count() == 4  # one new blob
    ledger.scan(two, ["path", "version"], "text", rule_version="next").collect()
    assert ledger.read("next").count() == 3
    assert m.BlobLedger(spark).scan(two.limit(0), ["path"], "text").collect() == []
