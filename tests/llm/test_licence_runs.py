import random

import pytest

from rungwise.llm import licences

MIT, APACHE = dict(licences.TEMPLATES)["MIT"], dict(licences.TEMPLATES)["Apache-2.0-header"]
PROSE = "the quick brown fox jumps over the lazy dog while nobody looks at it from afar " * 30


def test_texts_of_several_paragraphs_and_notices_within_lines(table):
    mit = MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    apache = APACHE.replace("License. You", "License.\nYou").replace("LICENSE-2.0 Unless", "LICENSE-2.0\n\nUnless")
    notice = "This package was written in 2020 by its authors. Released under the MIT License."
    rows = [(1, f"{PROSE}\n\n{mit}\n\n{PROSE}"), (2, f"{PROSE}\n\n{apache}\n\n{PROSE}"), (3, notice), (4, f"{PROSE} {notice} {PROSE} {notice}\nReleased under the MIT License."), (5, PROSE), (6, None)]
    got = {r["doc_id"]: (r["licence"], r["dice"], r["unit"], r["n_segments"]) for r in licences.scan(table(rows)).collect()}
    assert got[1] == ("MIT", 1.0, "words", 1) and got[2] == ("Apache-2.0-header", 1.0, "words", 1)
    assert got[3] == ("MIT-notice", 1.0, "words", 1) and got[4] == ("MIT-notice", 1.0, "line", 3)
    assert got[5] == got[6] == (None, 0.0, None, 0)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_best_run_is_that_of_all_runs(threshold):
    rnd = random.Random(5)
    templates = (("one", "a b c d e"), ("two", "b c a b d d a c e a"), ("three", "f"), ("four", "c d e f a b"))
    scanner = licences.Scanner(templates, threshold)
    for _ in range(300):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            words += templates[rnd.choice([0, 1, 3])][1].split()[rnd.randrange(2) :]
        best = (0.0, 0)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                have = licences.bigrams(words[i:j])
                best = max([best, *((2 * len(have & s) / (len(have) + len(s)), -k) for _, s, k in scanner.sets)])
        got = scanner.runs(words)
        assert (not got and best[0] < threshold) or (-got[0][0], -got[0][1]) == best


def test_repeated_notices_take_linear_time():
    scanner = licences.Scanner()
    assert scanner.scan(" ".join(f"x{i} Released under the MIT License. y{i}" for i in range(20000))) == ("MIT-notice", 1.0, "words", 20000)


def test_templates_of_the_caller_and_very_long_texts(table):
    grant = " ".join(f"clause{i} grants right{i % 7} to holder{i % 11}" for i in range(400))
    templates = licences.with_texts({"Own-1.0": grant})
    prose = "words of a story that goes on and on " * 40_000
    rows = [(1, prose + grant.replace("clause9 ", "claus9 ") + prose), (2, prose), (3, grant), (3, grant), (4, "  \n\n ")]
    found = {r["doc_id"]: r["licence"] for r in licences.scan(table(rows), templates).collect()}
    assert found == {1: "Own-1.0", 2: None, 3: "Own-1.0", 4: None}
