"""Personal data against the patterns as given, run with Python's engine."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from logvigil.llm import pii

GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def expected(text):
    out = []
    for nth, (kind, pattern) in enumerate(GIVEN.items()):
        out += [(m.start(), nth, m.end(), kind) for m in re.finditer(pattern, text) if passes(kind, m.group())]
    return sorted(out)


TEXTS = [
    None, "", "plain", "a@b.c.@d.e x@y", "é😀 me.too+x@mail-host.example.org, 1.2.3.4.5.6.7.8 and 300.1.1.1 or 010.0.0.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111111111111111 5", "call +1 (555) 123-4567 or +12 or +1234567890123456",
    "IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32. DE89370400440532013001", "social security 123-45-6789" + "." * 90 + "id 123-45-6789",
    "9" * 5_000, "1 " * 20_000, "a" * 50_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "+" * 3_000, "1.2.3.4 " * 500,
]


def test_base_spans(make):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("a1@.-+ 59()é") for _ in range(400)) for _ in range(150)]
    texts += [" ".join(rnd.choice(["4012888888881881", "378282246310005", "x@y.z", "10.0.0.7", "+49 30 1234567", "mot", "12-34"]) for _ in range(40)) for _ in range(20)]
    got = {r.doc_id: r for r in pii.find(make(texts)).collect()}
    for i, text in enumerate(texts):
        want = expected(text or "")
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        own = [x for x in got[i].spans.split(",") if x and x.split(":")[0] in GIVEN]
        assert ",".join(own) == line
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        for kind in GIVEN:
            assert got[i][f"n_{kind}"] == sum(w[3] == kind for w in want)
    assert got[7].n_iban == 2 and got[8].n_ssn == 1
    assert got[5].scores.startswith("0.9")


def test_redaction(make):
    texts = ["mail x@y.zz now 10.1.2.3", "nothing", "", "4111 1111 1111 1111"]
    rows = make(texts).select("doc_id", pii.redact(F.col("text"), pii.spans_of(F.col("text"))).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["mail <EMAIL> now <IP>", "nothing", "", "<CARD>"]


def test_empty_table(make):
    assert pii.find(make([])).count() == 0


IBANS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"]


def test_iban_ends(make):
    after = [" The rest", " I paid", " EUR 50", " 2024", " 2024 AND ALL THE REST OF IT IN CAPITALS", "", ".", ", then", " DE89370400440532013000 I", "  X"]
    texts = [f"IBAN {iban}{tail}" for iban in IBANS for tail in after]
    texts += ["IBAN DE89370400440532013000abc", "IBAN DE89370400440532013000X", "ref AB12 DE89 3704 0044 0532 0130 00 I paid", "é😀 GB82 WEST 1234 5698 7654 32 A",
              "IBAN DE89 3704 0044 0532 0130 01 The"]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.find(make(texts)).collect()}
    for i, text in enumerate(texts[:len(IBANS) * len(after)]):
        iban = IBANS[i // len(after)]
        want = [f"iban:5:{5 + len(iban)}"] + ([f"iban:{6 + len(iban)}:{28 + len(iban)}"] if text.endswith("000 I") else [])
        assert got[i] == want, text
    assert [got[i] for i in range(len(IBANS) * len(after), len(texts))] == [[], [], ["iban:9:36"], ["iban:3:30"], []]


def test_iban_redaction(make):
    rows = make(["to DE89370400440532013000 The rest", "to GB82 WEST 1234 5698 7654 32 2024"]).select(
        "doc_id", pii.redact(F.col("text"), pii.spans_of(F.col("text"))).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["to <IBAN> The rest", "to <IBAN> 2024"]


def test_iban_of_unregistered_country(make):
    def check(country, rest):
        digits = "".join(str(int(c, 36)) for c in rest + country + "00")
        return f"{country}{98 - int(digits) % 97:02d}{rest}"
    iban = check("ZZ", "00112233445566")
    got = pii.find(make([f"IBAN {iban} The", f"IBAN {iban}"])).collect()
    assert {r.spans for r in got} == {f"iban:5:{5 + len(iban)}"}
