"""Added spans of personal data: names behind capitals, overlaps against brute force, planted spans, long texts."""

import random
import time

import pytest

from panelforge.llm import pii

FILLER = "the report of last week shows that sales in the north were higher than expected and the team will meet again soon".split()
SURNAMES = "Miller Novak Rossi Keller Dupont Garcia Weber Lindholm Okafor Tanaka Moreau Schulz".split()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dear Alice Smith, thanks.", ["Alice Smith"]), ("Contact Maria Lopez today", ["Maria Lopez"]), ("Yesterday Maria Lopez called.", ["Maria Lopez"]), ("Patient Emma Wilson", ["Emma Wilson"]),
        ("I met Maria Lopez", ["Maria Lopez"]), ("The Late Night Show With Anna Berg Tonight", ["Anna Berg"]), ("my name is Xavi Torrente and", ["Xavi Torrente"]), ("Mr. John Smith", ["Mr. John Smith", "John Smith"]),
        ("Frau Petra Klein", ["Frau Petra Klein", "Petra Klein"]), ("xMaria Lopez", []), ("NEW YORK IS", []), ("", []), ("Maria", []), ("Maria  Lopez", []),
    ],
)
def test_names_behind_other_words(text, want):
    assert [text[s:e] for k, s, e, _ in pii.proposals(text) if k == "person"] == want


def test_a_gazetteer_of_the_user():
    assert pii.proposals("with Zebulon Pike there") == []
    assert pii.proposals("with Zebulon Pike there", frozenset({"zebulon"})) == [("person", 5, 17, True)]


def number(r, n):
    return "".join(r.choice("0123456789") for _ in range(n))


def iban(r):
    b = number(r, 18)
    return f"DE{98 - int(''.join(str(int(c, 36)) for c in b + 'DE00')) % 97:02d}{b}"


def planted(seed, size):
    """Texts with personal data, with look-alikes, and the spans that are personal."""
    r = random.Random(seed)
    names = sorted(pii.NAMES)
    real = {
        "national": lambda: (r.choice(["SSN ", "social security ", ""]), f"{r.choice(['123', '456', '221', '078'])}-{number(r, 2)}-{number(r, 4)}"), "iban": lambda: (r.choice(["IBAN ", "bank: ", ""]), iban(r)),
        "mac": lambda: (r.choice(["device ", ""]), ":".join(f"{r.randrange(256):02x}" for _ in range(6))), "local_phone": lambda: (r.choice(["phone ", "call ", "mobile "]), r.choice([f"({number(r, 3)}) {number(r, 3)}-{number(r, 4)}", f"{number(r, 3)}-{number(r, 3)}-{number(r, 4)}"])),
        "account": lambda: (r.choice(["account no. ", "konto ", "passport ", "license number "]), number(r, 9)), "person": lambda: (r.choice(["Dear ", "Contact ", "my name is ", "", "Yesterday ", "Patient "]), f"{r.choice(names).capitalize()} {r.choice(SURNAMES)}"),
    }
    false = {
        "national": lambda: (r.choice(["part ", "model ", "order "]), f"{r.choice(['000', '999', '901'])}-{number(r, 2)}-{number(r, 4)}"), "iban": lambda: (r.choice(["version ", "model "]), "DE00" + number(r, 18)), "mac": lambda: ("", "00:00:00:00:00:00"),
        "local_phone": lambda: (r.choice(["invoice ", "part ", "isbn "]), f"{number(r, 3)}-{number(r, 3)}-{number(r, 4)}"), "person": lambda: ("", f"{r.choice(['Grand', 'North', 'Annual'])} {r.choice(['Report', 'Station', 'Review'])}"),
    }
    texts, truth = [], []
    for _ in range(size):
        text, spans = "", []
        for _ in range(4):
            text += " ".join(r.choices(FILLER, k=6)) + " "
            if (x := r.random()) < 0.6:
                kind = r.choice(list(real if x < 0.35 else false))
                before, span = (real if x < 0.35 else false)[kind]()
                spans += [(kind, len(text) + len(before), len(text) + len(before) + len(span))] if x < 0.35 else []
                text += before + span
            text += r.choice([". ", ", ", " and "])
        texts.append(text)
        truth.append(spans)
    return texts, truth


def counted(texts):
    seen = {}
    for t in texts:
        for kind, _, _, v in pii.extra_spans(t, pii.base_spans(t)):
            seen[kind, v] = seen.get((kind, v), 0) + 1
    return seen


def test_precision_and_recall_on_planted_spans():
    weights = pii.span_classifier(counted(planted(1, 1200)[0]))
    right, wrong, missed = {}, {}, {}
    for text, spans in zip(*planted(2, 1200), strict=True):  # other texts than those that it is trained on
        got = [x for x in pii.spans_of(text, weights) if x[0] not in pii.BASE]
        for kind, s, e in got:
            into = right if any(k == kind and s < f and b < e for k, b, f in spans) else wrong
            into[kind] = into.get(kind, 0) + 1
        for kind, s, e in spans:
            missed[kind] = missed.get(kind, 0) + (not any(k == kind and s < f and b < e for k, b, f in got))
    for kind in pii.KINDS[len(pii.BASE) :]:
        assert right[kind] > 100 and wrong.get(kind, 0) <= 0.02 * right[kind] and missed[kind] <= 0.05 * right[kind], kind


def test_labelers_that_only_vote_one_way_are_told_apart():
    """Context votes 1 or abstains: how often it does in either class is what it tells."""
    r, seen = random.Random(3), {}
    for _ in range(20_000):
        y = r.random() < 0.3
        votes = "--" + ("1" if r.random() < (0.8 if y else 0.05) else "-") + ("0" if r.random() < (0.02 if y else 0.6) else "-") + ("1" if r.random() < (0.5 if y else 0.02) else "-") + "-"
        seen["person", votes] = seen.get(("person", votes), 0) + 1
    _, p = pii.reliabilities(seen)
    assert p["person", "--1-1-"] > 0.95 and p["person", "---0--"] < 0.05 and p["person", "--1---"] > p["person", "------"]
    w = pii.span_classifier(seen)
    assert pii.accepted("person", "--1-1-", w) and not pii.accepted("person", "---0--", w) and not pii.accepted("person", "------", w)


def brute_settled(spans):
    left, out = list(spans), []
    while left:
        first = min(left, key=lambda x: (x[1], -x[2], pii.KINDS.index(x[0])))
        out.append(first)
        left = [x for x in left if x[1] >= first[2]]
    return out


def test_overlaps_against_brute_force():
    r = random.Random(4)
    parts = ["Maria Lopez", "Dear", "Mr. ", " ", "SSN ", "123-45-6789", "(555) 123-4567", "a@b.co", "4111111111111111", "account no. 12345678", "DE89370400440532013000", "00:1a:2b:3c:4d:5e", "+1 202 555 0143", "Anna", "é", ", "]
    weights = pii.span_classifier(counted(planted(1, 300)[0]))
    for _ in range(1500):
        text = "".join(r.choices(parts, k=12))
        base = pii.base_spans(text)
        extra = pii.extra_spans(text, base)
        free = [p[:3] for p in pii.proposals(text) if not any(p[1] < f and b < p[2] for _, b, f in base)]
        assert [x[:3] for x in extra] == free
        taken = [x[:3] for x in extra if pii.accepted(x[0], x[3], weights)]
        want = sorted(base + brute_settled(taken), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert pii.spans_of(text, weights) == want


def test_a_rejected_proposal_hides_none():
    weights = pii.span_classifier({("person", "-1----"): 50, ("account", "---0--"): 50, ("national", "1-1---"): 30})
    assert pii.settled([("account", 0, 9), ("national", 4, 15)]) == [("account", 0, 9)]
    assert [s[0] for s in pii.spans_of("SSN 123-45-6789", weights)] == ["national"]


def test_long_texts_cost_what_short_ones_do():
    weights = pii.span_classifier(counted(planted(1, 300)[0]))
    piece = "Maria Lopez 4111111111111111 a@b.co " * 500

    def took(text):
        out = []
        for _ in range(3):
            t = time.perf_counter()
            pii.spans_of(text, weights)
            out.append(time.perf_counter() - t)
        return min(out)

    assert len(pii.spans_of(piece * 8, weights)) == 8 * 500 * 3
    assert took(piece * 8) < 8 * 3 * took(piece)
