"""Problem 1 on wordings that stand in none of the tables."""

import wordings

from webloom.llm import residue


def test_unknown_wordings():
    matcher = residue.build()
    found = lambda block: [bool(residue.judge(matcher, None, x)[0]) for x in wordings.listed(block)]
    messages, later, prose = found(wordings.MESSAGES), found(wordings.LATER), found(wordings.PROSE)
    assert sum(messages) >= 0.9 * len(messages) and sum(later) >= 0.85 * len(later) and sum(prose) <= 2


def test_one_message_in_a_page_is_a_spot_and_does_not_exclude_it():
    matcher = residue.build()
    body = "We make pumps for small boats and service them all year. " * 20
    spots, coverage = residue.judge(matcher, "Pumps", body + "\nSorry, this page doesn't exist.\n" + body)
    assert spots == 1 and 0 < coverage < 0.05
    spots, coverage = residue.judge(matcher, None, "Page not found\nSorry, this page doesn't exist.")
    assert spots == 2 and coverage == 1.0
    assert residue.judge(matcher, None, "x " * 200_000) == (0, 0.0) and residue.judge(matcher, "", "") == (0, 0.0)
