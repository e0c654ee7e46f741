"""Licence scans against comparison with every template."""

import random

from jobruns.llm import licences
from jobruns.llm.licences import TEMPLATES, Scanner, bigrams, dice, scan_licences, words


def every(units, least):
    out = []
    for kind, start, end, lines in units:
        own = bigrams([w for line in lines for w in line])
        scores = [(dice(bigrams(words(t)), own), name) for name, texts in TEMPLATES.items() for t in texts]
        best = max(scores)
        if best[0] >= least:
            out.append((best[1], kind, start, end))
    return out


def test_pruned_scans_lose_nothing():
    rng = random.Random(6)
    texts = []
    for name in TEMPLATES:
        for t in TEMPLATES[name]:
            tokens = t.split()
            for share in (0.0, 0.05, 0.1, 0.2):
                noisy = [w for w in tokens if rng.random() >= share / 2]
                noisy = [("other" if rng.random() < share / 2 else w) for w in noisy]
                cut = rng.randrange(1, max(2, len(noisy)))
                texts.append("Prose before it.\n\n" + " ".join(noisy[:cut]) + "\n" + " ".join(noisy[cut:]) + "\n\n\nAnd after.")
    scanner, found = Scanner(), 0
    for t in texts:
        got = [(m["licence"], m["unit"], m["first"], m["last"]) for m in scanner.scan(t) if m["unit"] != "window"]
        assert got == every(scanner._units(t), licences.LEAST)
        found += bool(got)
    assert found > len(texts) * 0.6
    units = sum(len(list(scanner._units(t))) for t in texts)
    assert scanner.compared < units * len(scanner.made) / 3


def test_spans_and_kinds():
    mit = TEMPLATES["MIT"][2]
    assert Scanner().scan("intro\nreleased  under the mit licence\nReleased under the MIT License!")[0]["first"] == 38
    (whole,) = [m for m in Scanner().scan("x\n\n" + mit.replace(". ", ".\n")) if m["unit"] == "paragraph"]
    assert whole["licence"] == "MIT" and whole["first"] == 3 and whole["dice"] > 0.99
    assert Scanner().scan("") == Scanner().scan("\n\n \n") == Scanner().scan("one") == []
    assert [m["licence"] for m in Scanner().scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]


def test_odd_rows(odd, none):
    found = {r.doc_id: r.matches for r in scan_licences(odd).collect()}
    assert [m.licence for m in found[10]] == ["MIT"]
    assert all(not m for i, m in found.items() if i != 10)
    assert scan_licences(odd).count() == odd.count()
    assert scan_licences(none).count() == 0


PROSE = "the quick river runs past old mills and nobody in town remembers who built them or why they stand empty today".split()


def _planted(name, template, how, i):
    """The template in other words: in a sentence, as a comment, or with its paragraphs split in a longer text."""
    before, after = " ".join(PROSE[i % 7 :]), " ".join(PROSE[: 5 + i % 9])
    tokens = template.split()
    if how == "prose":
        return f"{before}. {' '.join(tokens)} {after}."
    if how == "comment":
        lines = [" ".join(tokens[j : j + 7]) for j in range(0, len(tokens), 7)]
        return f"# {before}\n" + "\n".join(f"# {x}" for x in lines) + f"\nimport os  # {after}"
    half = len(tokens) // 2
    return f"{before}\n\n{' '.join(tokens[:half])}\n\n{' '.join(tokens[half:])}\n\n{after}\n\n{before}"


def test_planted_licences_are_found_wherever_they_stand():
    scanner = licences.Scanner()
    for i, (name, template) in enumerate((n, t) for n, ts in licences.TEMPLATES.items() for t in ts):
        for how in ("prose", "comment", "split"):
            text = _planted(name, template, how, i)
            assert name in {m["licence"] for m in scanner.scan(text)}, (name, how)
    assert scanner.scan(" ".join(PROSE * 40)) == []


def test_best_windows_equal_all_windows_tried():
    """Brute force over every window of words, with a coefficient of its own."""
    rng = random.Random(6)
    vocabulary = list("abcdefgh")
    for _ in range(150):
        template = [rng.choice(vocabulary) for _ in range(rng.randint(3, 9))]
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        text += [w if rng.random() < 0.9 else "x" for w in template] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        scanner = licences.Scanner({"T": [" ".join(template)]})
        pairs = list(zip(text, text[1:], strict=False))
        own, best = sorted(zip(template, template[1:], strict=False)), 0.0
        for s in range(len(pairs)):
            for e in range(s + 1, len(pairs) + 1):
                rest, both = list(own), 0
                for pair in pairs[s:e]:
                    if pair in rest:
                        rest.remove(pair)
                        both += 1
                best = max(best, 2 * both / (len(own) + e - s))
        found = list(scanner._windows(pairs, 0)) if pairs else []
        assert (max((f[1] for f in found), default=0.0)) == (best if best >= 0.8 else 0.0)
        ends = sorted((first, last) for _, _, first, last in found)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_windows_keep_their_place_in_letters_that_grow():
    text = "\u0130\u0130 Copyright 2020 Jane Doe. Released under the MIT License. See LICENSE for details."
    (match,) = licences.Scanner().scan(text)
    assert match["unit"] == "window" and text[match["first"] : match["last"]] == "Released under the MIT License"
