import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import packing
from lodeworks.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_word_ids_are_the_tokenizers(odd_documents):
    whole, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(6)
    texts = [t or "" for _, t, *_ in odd_documents]
    texts += ["It's <|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "İ H̱. T̈, é.", "a|b | ||", "can't. 12,3. ... ,,a., b!?", " wide space \x1f", "Σ ΣΑΣ. İ ẞ", "|"]
    texts += ["".join(rng.choice("aAbB.,|'! \n1é́_*<>-") for _ in range(rng.randrange(80))) for _ in range(800)]
    for _ in range(2):  # once while words are learned, once from memory
        for t in texts:
            assert np.frombuffer(words.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_knapsack_and_plan():
    rng = random.Random(1)
    sizes = np.array([3, 5, 7])
    assert packing.best_configuration(sizes, np.array([3.0, 5.1, 7.0]), 10) == Counter({5: 2})
    for _ in range(20):
        cap = rng.choice([10, 50, 200])
        counts = {rng.randint(1, cap): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
        made = packing.plan(counts, cap, 60)
        held = Counter()
        for config, times in made:
            assert times > 0 and sum(s * k for s, k in config.items()) <= cap
            held.update({s: k * times for s, k in config.items()})
        assert held == counts
        big = [s for s in counts for _ in range(counts[s])]
        bins = []
        for s in sorted(big, reverse=True):  # first fit decreasing
            at = next((i for i, b in enumerate(bins) if b + s <= cap), None)
            if at is None:
                bins.append(s)
            else:
                bins[at] += s
        assert sum(t for _, t in made) <= len(bins) * 1.02 + 2
    assert packing.plan({}, 10) == []


def test_program_covers_every_size_and_places_most_pieces():
    rng, cap = random.Random(4), 512
    counts = {s: 1 + int(4_000_000 / (s + 20) ** 1.5 * rng.random()) for s in range(1, cap)}
    covered = Counter()
    for config, times in packing.configuration_lp(counts, cap):
        assert times > 0 and sum(s * k for s, k in config.items()) <= cap
        for s, k in config.items():
            covered[s] += k * times
    assert all((1 - packing.COVER_ERROR) * n - 1e-6 <= covered[s] <= n + 1e-6 for s, n in counts.items())
    least = sum(s * n for s, n in counts.items()) / cap
    assert sum(t for _, t in packing.plan(counts, cap)) <= least * 1.01 + 1
    placed, held = [], Counter()
    filling, packing._fill = packing._fill, lambda left, capacity, made: placed.extend(made)
    try:
        packing.plan(counts, cap)
    finally:
        packing._fill = filling
    for config, times in placed:
        held.update({s: s * k * times for s, k in config.items()})
    assert sum(held.values()) >= 0.8 * least * cap


def test_the_program_makes_the_result():
    rng, cap = random.Random(12), 1024
    counts = {s: 25 * (1 + int(rng.random() * 6000 / (s + 30))) for s in range(1, cap)}
    placed, filling = [], packing._fill
    packing._fill = lambda left, capacity, made: placed.extend(made)
    try:
        packing.plan(counts, cap)
    finally:
        packing._fill = filling
    tokens = sum(s * n for s, n in counts.items())
    assert sum(s * k * times for config, times in placed for s, k in config.items()) >= 0.95 * tokens
    assert sum(t for _, t in packing.plan(counts, cap)) <= tokens / cap * 1.001 + 1


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pack_holds_every_token_once(odd, odd_documents, capacity):
    whole = Tokenizer.from_file(PATH)
    rows = packing.pack(odd, PATH, capacity=capacity, rounds=40, keep_ids=True).collect()
    want = Counter()
    for i, t, *_ in odd_documents:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), capacity):
            part = np.array(ids[p : p + capacity], "<u4").tobytes()
            want[i, p // capacity, p, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(sequences) <= least * 1.05 + 1


def test_empty(nothing):
    assert packing.pack(nothing, PATH, rounds=5).count() == 0
