"""op5 and op6 against plain regular expressions."""
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagecurate.llm import pii, secret_links

SF_SMALL = "/root/testdata/sf0.001"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    alt = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])]
    return sum(alt) % 10 == 0


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, t) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(CARD, t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def brute_secrets(t):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_links.KINDS.index(s[0])))


def base(spans, kinds):
    return [s for s in spans if s[0] in kinds]


pii_texts = st.text(alphabet="a.@-+% 0123459é😀\n()", max_size=60)
secret_texts = st.lists(st.sampled_from(["token", "SECRET", "api_key", "ApiKey", ":", "=", " ", '"', "AKIA", "ABCD0123EFGH4567", "abcdef",
                                         "0123456789abcdef", "host", "://", "x.y", "\n", "ſ", "é", "a1b2c3d4e5f6g7h8i9j0k", "user=bob"]), max_size=14).map("".join)


@settings(max_examples=1500, deadline=None)
@given(pii_texts)
def test_pii_base_spans_equal_the_patterns(t):
    assert base(pii.find_spans(t), pii.BASE_KINDS) == brute_pii(t)


@settings(max_examples=1500, deadline=None)
@given(secret_texts)
def test_secret_base_spans_equal_the_patterns(t):
    assert base(secret_links.find_spans(t), secret_links.BASE_KINDS) == brute_secrets(t)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


@pytest.mark.parametrize("mod,query,brute,counts", [
    (pii, "op6_pii", brute_pii, ["email", "ip", "card", "phone"]),
    (secret_links, "op5_secrets", brute_secrets, ["assign", "access", "hex"])])
def test_query_equals_the_patterns(spark, mod, query, brute, counts):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = getattr(mod, query)(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in counts] == [sum(s[0] == k for s in want) for k in counts]


def test_pii_added_kinds():
    t = "see https://bob:pw@host.example/x and iban GB82 WEST 1234 5698 7654 32 now; account no. 12-3456-78 ok https://a.b/c"
    kinds = {t[s:e]: k for k, s, e in pii.find_spans(t)}
    assert kinds["https://bob:pw@host.example/x"] == "url"
    assert kinds["GB82 WEST 1234 5698 7654 32"] == "account"
    assert kinds["12-3456-78"] == "account"
    assert "https://a.b/c" not in kinds


def test_weak_candidates_need_their_other_half():
    weak = "Zk3vQ9x1Lm7Tr2Ws8Yd5"
    assert secret_links.find_spans(f"nothing near {weak} here") == []
    linked = secret_links.find_spans(f"client_id = bob7 {weak}")
    assert [k for k, _, _ in linked] == ["weak_access", "weak_secret"]
    apart = "client_id = bob7" + " x" * secret_links.REACH + f" {weak}"
    assert secret_links.find_spans(apart) == []
    assert secret_links.find_spans(f"client_id = bob7\n\n{weak}") == []
    kinds = [k for k, _, _ in secret_links.find_spans(f"https://db.example:5432/x {weak}")]
    assert kinds == ["endpoint", "weak_secret"]
    assert secret_links.find_spans("https://db.example/x client_id=bob7") == []


@pytest.mark.parametrize("mod,find,out", [(pii, "find_pii", "pii"), (secret_links, "find_secrets", "secrets")])
def test_edge_rows(spark, mod, find, out):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x@y.zz token=abcdef1", None), (4, "x@y.zz token=abcdef1", "c"), (4, "x@y.zz token=abcdef1", "c"),
            (5, "word " * 200_000 + "x@y.zz password: hunter22", "d")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {out} string")
    got = getattr(mod, find)(df)
    assert got.columns == ["doc_id", "text", out]
    by = [(r.doc_id, [s.kind for s in r[out]]) for r in got.collect()]
    kind = "email" if out == "pii" else "assign"
    assert sorted(by, key=str) == sorted([(1, []), (2, []), (None, [kind]), (4, [kind]), (4, [kind]), (5, [kind])], key=str)
    assert getattr(mod, find)(df.limit(0)).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz, é call +1 (555) 123-4567 now"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.mask_pii(df).orderBy("doc_id").collect()] == ["mail [email], é call [phone] now", None]


def test_long_strong_parts_reach_over_inner_ones():
    hexes = "0123456789abcdef01234567", "89abcdef0123456789abcdef"
    inner = f"token={hexes[0]}-{hexes[1]}-"
    text = inner + "zz" * ((460 - len(inner)) // 2) + " " * 10 + "host: db.example.org"
    spans = secret_links.find_spans(text)
    assert [k for k, _, _ in spans].count("hex") == 2 and spans[-1][0] == "endpoint"
    # more runs than kinds inside one assign: no weak part is added inside it
    runs = "x".join(["0123456789abcdef01234567"] * 5) + "+Zq9Lm3Xw8Rt5Vb2Np7Ks4"
    tokens = secret_links.find_spans(f"secret={runs}. client_id=abcdef")
    assert "weak_secret" not in [k for k, _, _ in tokens]
    parts = [(0, 460, "assign"), (6, 30, "hex"), (31, 55, "hex"), (470, 480, "endpoint"), (761, 765, "endpoint")]
    assert (470, 480, "endpoint") in secret_links._linked("x" * 800, parts) and (761, 765, "endpoint") not in secret_links._linked("x" * 800, parts)


@pytest.mark.parametrize("cue", ["Customer ID", "Customer Id", "customer iD", "Member ID", "MEMBER id", "aCCount", "SSn"])
def test_account_cues_in_any_case(cue):
    text = f"her {cue}: 12345678 ok"
    assert pii.find_spans(text) == [("account", text.index("1"), text.index(" ok"))]
    assert pii.find_spans("IBan GB82 WEST 1234 5698 7654 32") == [("account", 5, 32)]


_OLD_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s<>"']+|\b[Hh][Oo][Ss][Tt]["']? *[:=] *["']?[A-Za-z0-9.-]+(?::[0-9]+)?""")


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["host", "HOST", ":", "://", "//", "/", "=", " ", '"', "a", "9", ".", "-", "http", "x.y", "\n", "é", "<", "1:80"]), max_size=14).map("".join))
def test_endpoints_equal_the_plain_pattern(text):
    assert secret_links.endpoints(text) == [m.span() for m in _OLD_ENDPOINT.finditer(text)]


def test_long_runs_take_linear_time():
    import time
    start = time.perf_counter()
    for text in ("a" * 1_000_000 + "://x", "a." * 500_000 + " host", "://" + "b" * 1_000_000, "9a://" * 200_000, "host:" * 200_000 + "://"):
        secret_links.find_spans(text)
    assert time.perf_counter() - start < 10
    start = time.perf_counter()
    secret_links.endpoints("x" * 1_000_000 + " ://")
    assert time.perf_counter() - start < 1
