"""Packing, leak search and offensive language against brute force and round trips."""

import random

import numpy as np
import pytest

from stratalens.llm.fm_index import FMIndex, Wavelet, build_index, leaks, removal_spans, search_index, split_words, suffix_array
from stratalens.llm.lexicon import EXCEPTIONS, LEXICON
from stratalens.llm.offensive import evidence, fold, offensive
from stratalens.llm.packing import _encoding, harmonic, pack

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("capacity", [1, 10, 2048])
def test_harmonic_keeps_to_the_capacity(capacity):
    rnd = random.Random(capacity)
    sizes = [min(capacity, max(1, int(rnd.expovariate(6 / capacity)))) for _ in range(3000)]
    place = harmonic(sizes, capacity)
    used = np.bincount(place, weights=sizes)
    assert used.max() <= capacity and used.min() > 0 and len(place) == len(sizes)
    assert sum(sizes) / (len(used) * capacity) > 0.95
    assert harmonic([], capacity) == []


def test_equal_lengths_fill_their_class(spark):
    assert set(np.bincount(harmonic([512] * 400, 2048))) == {4}
    assert set(np.bincount(harmonic([682] * 300, 2048))) == {3}


def test_many_short_items_take_linear_time():
    rnd = random.Random(4)
    sizes = [rnd.randrange(1, 32) for _ in range(300_000)]
    used = np.bincount(harmonic(sizes, 2048), weights=sizes)
    assert used.max() <= 2048 and sum(sizes) / (len(used) * 2048) > 0.999


def test_windows_pack_apart(spark):
    rows = [(i, "word " * (1 + i % 40)) for i in range(300)]
    got = pack(spark.createDataFrame(rows, "id long, t string").coalesce(1), "id", "t", 128, RANKS, window=50).collect()
    bins = {}
    for r in got:
        bins[r.container] = bins.get(r.container, 0) + r.n_tokens
    assert len(got) == 300 and max(bins.values()) <= 128


def test_pack_is_complete(spark):
    texts = [(0, None, "x"), (1, "", "x"), (2, "a word", "x"), (3, "word " * 5000, "x"), (4, "a word", "x"), (5, "   ", "x"), (6, "né " * 300, "x"), (None, "no id", "x"), (2, "a word", "x")]
    got = pack(spark.createDataFrame(texts, "id long, t string, ident string"), "id", "t", 128, RANKS).collect()
    with open(RANKS, "rb") as file:
        encoding = _encoding(file.read())
    want = {i: 0 for i, t, _ in texts if t}
    for i, t, _ in texts:
        if t:
            want[i] += len(encoding.encode_ordinary(t))
    have, bins = {}, {}
    for r in got:
        have[r.id] = have.get(r.id, 0) + r.n_tokens
        bins[r.container] = bins.get(r.container, 0) + r.n_tokens
    assert have == want and max(bins.values()) <= 128
    assert all(r.n_tokens == 128 for r in got if r.id == 3 and r.first_token + 128 <= want[3])
    assert len([r for r in got if r.id == 6]) == -(-want[6] // 128)
    assert pack(spark.createDataFrame([], "id long, t string"), "id", "t", 128, RANKS).count() == 0


def test_suffix_array_and_wavelet():
    rnd = np.random.default_rng(1)
    for alphabet in (2, 3, 40):
        text = np.append(rnd.integers(0, alphabet, 400), 0).astype(np.int32)
        order = suffix_array(text)
        key = lambda i, text=text: ([*text[i : i + int(np.argmax(text[i:] == 0)) + 1]], i)
        assert order.tolist() == sorted(range(len(text)), key=key)
        wave = Wavelet(text.astype(np.int64), alphabet)
        at = np.arange(len(text))
        assert (wave.access(at) == text).all()
        for c in range(alphabet):
            assert (wave.rank(np.full(len(at) + 1, c), np.arange(len(at) + 1)) == np.concatenate([[0], np.cumsum(text == c)])).all()
        index = FMIndex(text, alphabet)
        pieces = np.array([text[i : i + 3] for i in range(len(text) - 3) if 0 not in text[i : i + 3]] or np.zeros((0, 3)), np.int64)
        low, high = index.search(pieces)
        for piece, a, b in zip(pieces, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(text) - 2) if (text[i : i + 3] == piece).all()]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("alpha beta gamma delta Épée über 12 x9 straße".split())
    items = [(i, " ".join(word() for _ in range(rnd.randrange(3, 40)))) for i in range(12)] + [(90, None), (91, ""), (0, "again alpha")]
    docs = [(100, None), (101, ""), (102, "only other words here"), (103, "tail")]
    for n in range(40):
        part = split_words(items[rnd.randrange(12)][1])
        cut = part[rnd.randrange(len(part)) // 3 :][: rnd.randrange(8, 30)]
        joint = rnd.choice([" ", "\n> ", " ** ", "_", ", "])
        docs.append((n, " ".join(word() for _ in range(rnd.randrange(20))) + " zz " + joint.join(w.upper() if n % 2 else w for w in cut) + rnd.choice([" zz ", " "]) + word()))
    docs.append((0, docs[-1][1]))
    want = set()
    for d, t in docs:
        grams = {tuple(w[i : i + 13]) for w in [split_words(t)] for i in range(len(w) - 12)}
        want |= {(d, i) for i, u in items for w in [split_words(u)] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    corpus, tests = spark.createDataFrame([(*d, "x") for d in docs], "id long, text string, ident string"), spark.createDataFrame(items, "item long, text string")
    for shard, block in ((1_000_000, 1_000_000), (50, 20)):
        got = leaks(corpus, "id", "text", tests, "item", "text", 13, shard, block).collect()
        assert {(r.ident, r["item"]) for r in got} == want and len(want) > 5
    assert leaks(corpus.limit(0), "id", "text", tests, "item", "text").count() == leaks(corpus, "id", "text", tests.limit(0), "item", "text").count() == 0


def test_one_index_serves_several_sets_of_items(spark, tmp_path):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b c d e f g h"), (None, "x a b c y"), (7, "d e f g h c d e")], "id long, text string")
    index = build_index(docs, "id", "text", f"file:{tmp_path}/index", shard_words=4)
    find = lambda item, least: sorted((r.ident or 0, r.first_word, r.last_word) for r in search_index(index, spark.createDataFrame([(1, item)], "i int, t string"), "i", "t", least).collect())
    assert find("A, b! c.", 3) == [(0, 1, 3), (big, 0, 2)]
    assert find("c d e f", 3) == [(7, 0, 2), (7, 5, 7), (big, 2, 5)]
    assert find("nothing of it here", 2) == find("a b", 3) == []


def test_removal_spans_merge_what_touches(spark):
    spans = spark.createDataFrame([(1, 9, 0, 4), (1, 8, 3, 6), (1, 9, 7, 8), (1, 9, 10, 12), (2, 9, 0, 1), (None, 9, 5, 6)], "ident int, item int, first_word int, last_word int")
    assert sorted((r.ident or 0, r.first_word, r.last_word) for r in removal_spans(spans).collect()) == [(0, 5, 6), (1, 0, 8), (1, 10, 12), (2, 0, 1)]


def test_spans_are_merged(spark):
    words = [f"w{i}" for i in range(30)]
    corpus = spark.createDataFrame([(1, "pre " + " ".join(words) + " post"), (2, " ".join(words[:12]))], "id long, text string")
    got = leaks(corpus, "id", "text", spark.createDataFrame([("i", " ".join(words))], "item string, text string"), "item", "text").collect()
    assert [(r.ident, r["item"], r.first_word, r.last_word) for r in got] == [(1, "i", 1, 30)]


@pytest.mark.parametrize(
    ("text", "categories"),
    [
        ("Shut your mouth, you stupid idiot.", {"abuse"}), ("Shut your mouth, you $tup1d s c u m b a g.", {"abuse"}), ("Only a b***h would keep this picture, you f i l t h y l0ser.", {"abuse"}),
        ("Halt dein Maul, du dummer Ar$chl0ch.", {"abuse"}), ("Ferme ta gueule, c\u043enn\u0430rd r\u00e9pugnant.", {"abuse"}), ("What kind of worthless aaaasshole deletes it?", {"abuse"}),
        ("They are ver\u00admin and should be driven out of town.", {"hate"}), ("Solche Leute vermehren sich wie R\u0430tten.", {"hate"}), ("A h@rdcore p0rn clip.", {"sexual"}), ("Nude, legs spread, g3n1t@l$ in close-up.", {"sexual"}),
        ("The dumb waiter is stuck.", set()), ("Visible to the naked eye: a castle.", set()), ("Sussex, Essex and a violin.", set()), ("The bastard file was merged.", set()), ("This stupid disk is full again.", set()),
        ("Chicken breast, cock-a-leekie soup.", set()), ("The Sutreki dance group was wonderful.", set()), ("Rats bred in the barn near us.", set()), ("Aktstudie aus Marmor.", set()), (None, set()), ("", set()), ("\u200b***", set()),
    ],
)
def test_offensive_passages(text, categories):
    assert {c for c, (strongest, _, _) in evidence(text).items() if strongest >= 1} == categories


def test_distant_words_are_no_passage():
    assert evidence("stupid " + "lorem ipsum " * 30 + "idiot")["abuse"][0] < 1


def test_offensive_over_a_table(spark):
    rows = [(1, "Shut your mouth, you idiot. " * 3000, "x"), (2, None, "x"), (1, "Shut your mouth, you idiot. " * 3000, "x"), (None, "You piece of shit", "x")]
    df = spark.createDataFrame(rows, "id long, t string, category string")
    assert sorted((r.ident or 0, r.category) for r in offensive(df, "id", "t").collect()) == [(0, "abuse"), (1, "abuse"), (1, "abuse")]
    assert offensive(df.limit(0), "id", "t").count() == 0


def test_lexicon_is_folded_to_letters():
    phrases = [p for weights in LEXICON.values() for group in weights.values() for p in group] + list(EXCEPTIONS)
    assert all("".join(fold(p.replace("~", ""))) for p in phrases)


@pytest.mark.parametrize(
    ("text", "categories"),
    [
        ("You are a b*tch.", {"abuse"}), ("You f*cking id**t.", {"abuse"}), ("Shut your f*cking mouth.", {"abuse"}), ("You are a wh*re.", {"abuse"}), ("You are such a slut.", {"abuse"}),
        ("I'll kill you.", {"abuse"}), ("I will kill you", {"abuse"}), ("F*ck you!", {"abuse"}), ("You are a stupid*idiot*now.", {"abuse"}), ("They are verm*n.", {"hate"}),
        ("3*x*y and a*b are products.", set()), ("This *is* b*ld text.", set()), ("I will kill your process.", set()),
    ],
)
def test_partial_masks_and_plain_threats(text, categories):
    assert {c for c, (strongest, _, _) in evidence(text).items() if strongest >= 1} == categories


@pytest.mark.parametrize(
    ("text", "categories"),
    [
        ("I will kill you tonight, you worthless pig", {"abuse"}), ("Je vais te tuer, sale chien", {"abuse"}), ("Ich bring dich um, du Arschloch", {"abuse"}), ("Te voy a matar", {"abuse"}), ("f*** you", {"abuse"}), ("You absolute m0r0n!", {"abuse"}),
        ("All Xs are parasites and must be exterminated", {"hate"}), ("Those people are vermin", {"hate"}), ("C'est de la vermine, il faut les expulser", {"hate"}), ("Die sind alle Diebe und gehören abgeschoben", {"hate"}),
        ("she sucked him off while he fingered her", {"sexual"}), ("Wet pussy, hard cock", {"sexual"}), ("un film porno", {"sexual"}),
        ("He was called an idiot like you would not believe", set()), ("I'm going to beat you at chess", set()), ("The movie was stupid, useless and disgusting.", set()), ("Rats are vermin.", set()), ("I am such an idiot", set()), ("231 minutes de retard", set()), ("XXX marks the spot", set()),
    ],
)
def test_rewordings(text, categories):
    assert {c for c, (strongest, _, _) in evidence(text).items() if strongest >= 1} == categories


def test_many_hits_take_linear_time():
    strongest, total, letters = evidence("Shut your mouth, you stupid idiot. " * 40_000)["abuse"]
    assert strongest < 10 and total > 40_000 and letters == 40_000 * 27


def test_single_stars_part_words_that_are_not_marked():
    assert fold("a*b b*tch b***h stupid*idiot") == ["a", "b", "b*tch", "b***h", "stupid", "idiot"]
