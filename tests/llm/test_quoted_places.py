from rungwise.llm.toxicity import quoted_places


def test_only_closed_pairs_quote():
    assert quoted_places('he said "you fool" and left') == {2, 3}
    assert quoted_places('a 5" screen, then plain words to the end') == frozenset()
    assert quoted_places('a 5" screen\n\nnext "one two" three') == {4, 5}
    assert quoted_places('"one" two "three" four "five') == {0, 2}
    assert quoted_places('"one\ntwo" three') == {0, 1}
    assert quoted_places("«a b» c „d“ e") == {0, 1, 3}
    assert quoted_places("") == quoted_places('""') == frozenset()
