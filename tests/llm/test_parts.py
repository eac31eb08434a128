"""Parts of the text operators that need no session."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import encoding
from folioflow.llm.encoding import Encoder, blocks, values
from folioflow.llm.queries import tokenizer_file
from folioflow.llm.suffixes import blind_trie, deep_shallow

TEXT = st.text(st.sampled_from("ab É'Éß.,\n\t 12é\u3000\x1c!ﬁ"), max_size=40)


@pytest.mark.parametrize("name,word_level", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT | st.text(max_size=20), max_size=5))
def test_ids_are_those_of_whole_texts(name, word_level, texts):
    encoder = Encoder(tokenizer_file(name), word_level)
    texts += ["plain words, and more.", "don't\nstop", "", " a", "a ", "a\nb c", "Ǆ ÅÅ ς Σ."]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    wanted = [np.array(x.ids, dtype="<u4").tobytes() for x in whole]
    assert encoder.encode(texts) == wanted


def test_few_kept_words_give_the_same_ids():
    path = tokenizer_file("byte_bpe_50k.json")
    texts = [f"word{n} and{n} more here" for n in range(30)]
    few = [x for t in texts for x in Encoder(path, False, kept=5).encode([t])]
    assert few == Encoder(path, False).encode(texts)


@pytest.mark.parametrize("name,word_level", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_a_word_is_learnt_once_whatever_stands_behind_it(name, word_level):
    encoder = Encoder(tokenizer_file(name), word_level)
    words = ["once" + "".join(random.Random(n).choices("abcdefgh", k=12)) for n in range(300)]
    encoder.encode(["x " + " ".join(words)])
    kept = len(encoder.known)
    texts = ["x " + ", ".join(words), "x " + ". ".join(words) + ".", "x " + ",\nx ".join(words)]
    found = encoder.encode(texts)
    assert len(encoder.known) <= kept + 5
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert found == [np.array(x.ids, dtype="<u4").tobytes() for x in whole]


@pytest.mark.parametrize("name,word_level", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_letters_that_lower_by_their_place(name, word_level):
    encoder = Encoder(tokenizer_file(name), word_level)
    texts = ["a ΑΣ b", "ΑΣ.", "x İz b", "ẞ ǅa, ŉ.", "a,b.c, e.g. x.'s don't. é, it's."]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(x.ids, dtype="<u4").tobytes() for x in whole]


def test_blocks_of_a_batch(monkeypatch):
    """Rows in order, empty and very long ones too, and slices keep their own ids."""
    monkeypatch.setattr(encoding, "BLOCK_BYTES", 50)
    encoder = Encoder(tokenizer_file("byte_bpe_50k.json"), False)
    texts = ["", "a b", "long " * 30 + "x", "", "tab\there", "é, ß.\nNext", "last one " * 4, ""]
    batch = pa.record_batch([pa.array(["skipped", *texts])], names=["text"]).slice(1)
    whole = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    found, rows = [], []
    for part in blocks(batch, 0):
        rows.append(part.num_rows)
        ids, bounds = values(encoder.encode_column(part.column(0)))
        found += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert found == whole
    assert len(rows) > 2 and sum(rows) == len(texts)
    assert not list(blocks(batch.slice(0, 0), 0))
    ids, bounds = values(encoder.encode_column(pa.array(["", ""])))
    assert len(ids) == 0 and bounds.tolist() == [0, 0, 0]
    assert encoder.encode([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=9, max_size=9), min_size=1, max_size=30))
def test_blind_trie_sorts(strings):
    raw = [s.encode() for s in strings]
    order = blind_trie(raw)
    assert sorted(order) == list(range(len(raw)))
    assert [raw[i] for i in order] == sorted(raw)


@pytest.mark.parametrize("shallow", [1, 2, 5])
def test_deep_shallow_orders_and_gives_common_prefixes(shallow):
    rng = random.Random(shallow)
    stems = [bytes(rng.choices(b"ab", k=30)) for _ in range(6)]
    rows, groups = [], []
    for _ in range(500):
        stem = rng.choice(stems)
        cut = rng.randrange(31)
        rows.append(stem[:cut] + bytes(rng.choices(b"abc\xff", k=30 - cut)))
        groups.append(rng.randrange(4))
    matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(500, 30)
    order, common = deep_shallow(matrix, np.array(groups), shallow)
    keys = [(groups[i], rows[i]) for i in order]
    assert keys == sorted(keys)
    for n in range(1, 500):
        (g, a), (h, b) = keys[n - 1], keys[n]
        same = next((k for k in range(30) if a[k] != b[k]), 30) if g == h else 0
        assert common[n] == same
