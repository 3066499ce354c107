"""Parts of secrets of any length."""

import pytest

from feedloom.llm import secret_links


@pytest.mark.parametrize("size", [20, 512, 516, 40_000])
def test_long_parts_are_whole(size):
    token, user = ("Zx9Kq27LmNp4RtYu8VbC" * (size // 20 + 1))[:size], "u" * size
    url = "https://db.example.org/x?" + "y=1&" * (size // 4) + "end"
    text = f"login: {user} {token} {url} host: {'h' * size}"
    spans = secret_links.weak_spans(text, secret_links.base_spans(text))
    assert [(secret_links.KINDS[k], text[a:b]) for k, a, b in spans] == [
        ("ident", user), ("opaque", token), ("endpoint", url), ("endpoint", "h" * size)
    ]


def test_signed_url_is_whole():
    url = "https://db.example.org/x?" + "y=1&" * 80 + "Signature=" + "0a" * 32
    spans = secret_links.weak_spans(url, secret_links.base_spans(url))
    assert (5, 0, len(url)) in spans
