"""The vocabulary on addresses of clean pages and of others."""

from __future__ import annotations

import pytest

from scriptorium.llm.url_filter import UrlJudge, VOCABULARY
from scriptorium.llm.url_vocabulary import LIMIT, TERMS


@pytest.mark.parametrize(
    "url",
    [
        "https://visit-paris.net/free", "https://a.net/security/malware-analysis", "https://clinic.net/steroid-therapy", "https://best-shop.net/order", "https://a.net/x?ad=1&track=2", "https://diario.net/2024/estafa-bancaria",
        "https://a.net/how-to-avoid-phishing", "https://uni.net/trojan-war", "https://a.net/bank/credit", "https://a.net/buy-now/best-offer", "https://a.net/wildlife/farm", "https://essex.net/", "https://a.net/scunthorpe", "", "x",
        "https://shop.net/sale/today?free=1&win=2&bet=3",
    ],
)
def test_clean_addresses(url):
    assert UrlJudge(VOCABULARY, ()).judge(url)[3] == "allow"


@pytest.mark.parametrize("url", ["https://casino.net/", "http://a.net/free-bet", "https://cheap-pill.net/x", "https://ad.track.net/", "https://a.net/spam-farm", "https://a.net/C4S1N0s", "https://a.net/porno", "https://a.net/billig/kredit", "https://a.net/?q=casino"])
def test_others(url):
    assert UrlJudge(VOCABULARY, ()).judge(url)[3] == "block"


def test_terms_are_in_one_place():
    for weights in TERMS.values():
        for terms in weights.values():
            assert len(set(terms.split())) == len(terms.split())
    assert all(0 < w <= LIMIT for _, w in VOCABULARY.values()) and "paris" not in VOCABULARY
    print(len(VOCABULARY), len({t for t, _ in VOCABULARY.values()}))
