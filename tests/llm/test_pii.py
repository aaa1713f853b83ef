import hashlib
import random
import re

import pytest
from llm.conftest import ODD_TEXTS

from rentatlas.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    """The base spans by the plain patterns."""
    out = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


TEXTS = ["mail a.b+c@x-y.example.com, a@b, @b.c, a@@b.c, x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 "
         "0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 1",
         "+1 (988) 555-2485 +12 +1 2345678901234567 ++1 234 567 8", "٣٣٣٣ +١ 234567890", ""]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(2)
    bits = ["a", "1", "22", "4111111111111111", "@", ".", "-", " ", "+", "(", ")", "x.y", "255",
            "256", "é", "\n", "%", "0"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(30)))
                     for _ in range(20_000)]
    for text in texts:
        assert [tuple(s[:3]) for s in pii.find(text)[0]] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000,
                 "1 " * 100_000, "+1" + "(" * 200_000, "a." * 100_000 + "@"):
        pii.find(text)


@pytest.mark.parametrize("text,added", [
    ("IBAN GB82 WEST 1234 5698 7654 32.", ["iban:5:32"]),
    ("GB82WEST12345698765432", ["iban:0:22"]),
    ("GB82 WEST 1234 5698 7654 33", []),
    ("social security 078-05-1120", ["national_id:16:27"]),
    ("part 078-05-1120", []),
    ("credit card 378282246310005", ["card:12:27"]),
    ("378282246310006", []),
])
def test_added_spans_need_a_checksum_or_context(text, added):
    assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.find(text)[1]] == added


def test_context_moves_the_score():
    plain, near = pii.find("at 10.0.0.1 then")[0][0], pii.find("server ip 10.0.0.1")[0][0]
    assert plain.score == 0.6 and near.score == 1.0


def test_query_columns(spark, documents):
    rows = [(i + 100, t) for i, t in enumerate(TEXTS)] + ODD_TEXTS + [(90, "IBAN GB82 WEST 1234 "
            "5698 7654 32, mail a@b.c")]
    out = pii.span_digests(pii.find_spans(documents(rows, clash=True))).collect()
    assert len(out) == len(rows)
    for i, text in rows:
        spans = brute(text or "")
        joined = ",".join(":".join(map(str, s)) for s in spans)
        mine = [r for r in out if r.doc_id == i and
                r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()]
        assert mine
        for kind in pii.BASE_KINDS:
            assert mine[0][f"n_{kind}"] == sum(s[0] == kind for s in spans)
    last = next(r for r in out if r.doc_id == 90)
    assert last.spans == "email:39:44,iban:5:32" and last.n_added == 1
    assert pii.find_spans(documents([])).collect() == []


def test_masking(spark, documents):
    rows = [(1, "to a@b.c or +1 (988) 555-2485."), (2, None), (3, ""), (4, "clean"), (4, "clean")]
    df = documents(rows, clash=True)
    out = pii.mask_documents(df)
    assert out.schema == df.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    masked = "to <EMAIL> or <PHONE>."
    assert got == sorted([(1, masked, len(masked)), (2, None, None), (3, "", 0), (4, "clean", 5),
                          (4, "clean", 5)], key=str)


@pytest.mark.parametrize("text,found", [
    ("ES9121000418450200051332 BIC CAIXESBB", ["ES9121000418450200051332"]),
    ("AT611904300234573201 EUR 50", ["AT611904300234573201"]),
    ("PL61 1090 1014 0000 0712 1981 2874 VAT 23", ["PL61 1090 1014 0000 0712 1981 2874"]),
    ("NO93 8601 1117 947 OSLO", ["NO93 8601 1117 947"]),
    ("AT611904300234573201 ES9121000418450200051332", ["AT611904300234573201",
                                                       "ES9121000418450200051332"]),
    ("NR12 ABCD EFGH ES9121000418450200051332.", ["ES9121000418450200051332"]),
    ("AT611904300234573202 EUR 50", []),
    ("ES9121000418450200051332BIC", []),
])
def test_account_numbers_end_where_their_country_says(text, found):
    base, added = pii.find(text)
    assert [text[s.start:s.end] for s in added if s.kind == "iban"] == found
    hidden = pii.masked(text, base + added)
    assert not any(f in hidden for f in found) and hidden.count("<IBAN>") == len(found)
