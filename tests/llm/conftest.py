import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_llm import PROSE  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, white space, one character, ties, repeats, very long, and a single very long word."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "x"),
        (5, "two words"),
        (6, PROSE),
        (7, PROSE),
        (7, PROSE),
        (None, PROSE + "Null id."),
        (8, PROSE * 300),
        (9, "z" * 40_000),
        (10, "1 2" * 20_000),
        (11, "café ünï 漢字 \U0001f600 mixed \U0001f680 text café ünï"),
        (12, "a+b@c.d.e_f@g.h 10.0.0.256 10.0.0.1 +1 (202) 555-0147 4111 1111 1111 1111 4111111111111112"),
    ]
