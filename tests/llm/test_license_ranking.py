"""License scans: the ranking by compression decides, no notice is passed over by it, and dense cues take little time."""

import random
import time

import pytest

from tidemark.llm import licenses

PLAIN = ["river", "stone", "garden", "window", "letter", "music"]
DENSE = ["software", "domain", "permission", "notice", "license", "copyright", "public", "the", "of", "free"]


def two_templates():
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    short = [f"s{c}" for c in "abcdefgh"]
    long = ["".join(rng.choice("klmnopqrst") for _ in range(16)) for _ in range(8)]
    mixed = lambda own: [w for i in range(8) for w in (*common[i * 7 : i * 7 + 7], own[i])] + common[56:]
    return {"short": (" ".join(mixed(short)),), "long": (" ".join(mixed(long)),)}, " ".join(mixed([*long[:4], *short[4:]]))


def test_the_larger_reduction_decides_between_templates_that_differ_as_much(monkeypatch):
    templates, text = two_templates()
    found = licenses.Scanner(templates)(text)
    assert [(n.license, n.differences) for n in found] == [("long", 4)] and found[0].saved > 0

    class Nothing:
        def compress(self, data):
            return b""

    monkeypatch.setattr(licenses.Scanner, "_packer", classmethod(lambda cls, text: Nothing()))
    assert [(n.license, n.differences) for n in licenses.Scanner(templates)(text)] == [("short", 4)]


@pytest.mark.parametrize("around", [PLAIN, DENSE])
def test_no_notice_within_the_tolerance_is_passed_over(around):
    """As many changes as may be, spread evenly, which leaves the shortest runs: replaced, left out or with words put between."""
    scanner, rng = licenses.Scanner(), random.Random(21)
    for k, (name, own, _) in enumerate(scanner.known):
        most = scanner.most[k]
        free = [i for i in range(1, len(own) - 1) if own[i] not in scanner.needed[k]]
        for kind in ("replace", "drop", "insert") if most else ("none",):
            words: list[str] = []
            spots = {free[(2 * j + 1) * len(free) // (2 * most)] for j in range(most)}
            for i, w in enumerate(own):
                if i not in spots or kind == "insert":
                    words.append(w)
                if i in spots and kind != "drop":
                    words.append("".join(rng.choice("qxzjkvwy") for _ in range(11)))
            text = " ".join([*rng.choices(around, k=150), *words, *rng.choices(around, k=150)])
            found = [(n.license, n.differences <= most) for n in scanner(text)]
            assert (name, True) in found, (name, len(own), kind)


def test_relatives_are_told_apart_however_they_differ():
    templates, _ = two_templates()
    first = templates["short"][0].split()
    # six words of sixty-eight differ, as many as the tolerance lets pass
    near = [("x" + w) if i in (5, 15, 25, 35, 45, 55) else w for i, w in enumerate(first)]
    scanner = licenses.Scanner({"one": (" ".join(first),), "two": (" ".join(near),)})
    assert [(n.license, n.differences) for n in scanner(" ".join(first))] == [("one", 0)]
    assert [(n.license, n.differences) for n in scanner(" ".join(near))] == [("two", 0)]
    between = [a if i < 34 else b for i, (a, b) in enumerate(zip(first, near))]
    assert scanner(" ".join(between)) == []


@pytest.mark.parametrize("prose", ["the software of that domain is {} and {} . ", "permission notice software "])
def test_dense_cues_without_a_notice_are_mostly_passed_over(prose):
    rng = random.Random(3)
    text = "".join(prose.format(rng.choice(PLAIN), rng.choice(PLAIN)) for _ in range(200_000 // len(prose)))
    scanner = licenses.Scanner()
    began = time.process_time()
    assert scanner(text) == []
    assert time.process_time() - began < 3, "15 seconds a MB, and it takes 3"
    assert scanner.spared > 10 * scanner.aligned


def test_whole_licence_texts_have_one_notice():
    scanner = licenses.Scanner()
    for name in ("BSD-2-Clause", "BSD-3-Clause", "Unlicense", "MIT", "ISC"):
        body = max(licenses.TEMPLATES[name], key=len)
        assert [(n.license, n.differences, n.length) for n in scanner(f"Copyright 2020 A B\n\n{body}\n")] == [(name, 0, len(body) - 1)]
