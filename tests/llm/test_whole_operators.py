"""Operators return something for every row, copies and unseen forms among them."""

import numpy as np
import pytest

from strandloom.llm import audio, pii


def test_audio_copies(spark):
    """Queries keep their own ids, and copies are found in the membership."""
    rng = np.random.default_rng(4)
    a, b, c = ([int(x) for x in rng.integers(-(2**31), 2**31, 200)] for _ in range(3))
    rows = [(7, a), (50, a), (100, a), (8, a[40:180]), (150, b), (151, b), (9, c), (10, []), (11, None), (None, a)]
    prints = spark.createDataFrame(rows, "id long, fingerprint array<int>")
    found = audio.align_with_members(prints).collect()
    got = sorted((r["query"], r["recording"], r["copies"]) for r in found if r["kind"] == "match")
    assert got == [(50, 8, 1), (100, 8, 1)]
    classes = {r["query"]: (r["recording"], r["copies"]) for r in found if r["kind"] == "member"}
    assert classes == {7: (7, 3), 50: (7, 3), 100: (7, 3), 8: (8, 1), 150: (150, 2), 151: (150, 2), 9: (9, 1), 10: (None, None), 11: (None, None)}
    assert {r["id"]: r["class"] for r in audio.members(prints).collect()} == {k: v[0] for k, v in classes.items()}
    assert sorted((r["query"], r["recording"]) for r in audio.align(prints).collect()) == [g[:2] for g in got]


@pytest.mark.parametrize("text", ["john (AT) example (DOT) com", "jane at example.com", "john [ at ] example.com", "BOB AT EXAMPLE DOT COM", "x {AT} example.org"])
def test_candidates_without_digits(text):
    """The gate lets through all that the loose pattern matches."""
    text = f"write to {text}" if text[0] == "x" else text
    assert pii._LOOSE["email"].search(text) and [c[0] for c in pii.candidates(text)] == ["email"]


def test_hex_address_without_digits():
    assert [c[:3] for c in pii.candidates("host dead:beef:cafe:babe:feed:face:deaf:fade up")] == [("ip", 5, 44)]


def test_model_scores_unseen_features(spark):
    """A model fitted on some forms judges others by its weights, in workers too."""
    seen = ["mail john (at) example (dot) com"] * 30 + ["look at that.thing now"] * 30
    model = pii.fit(spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string"))
    new = "so jane [at] example dot org"
    ((kind, s, e, _, features),) = pii.candidates(new)
    assert (0, features) not in model
    found = pii.find_personal_data(spark.createDataFrame([(1, new)], "doc_id long, text string"), model).first()
    assert found["spans"] == [f"{kind}:{s}:{e}"]
    assert pii.added_spans(new, pii.train(pii.Counter())) == []


def test_limits_from_whole_recordings(spark):
    """What lies behind the first bytes of a long recording moves the limits."""
    rng = np.random.default_rng(5)
    quiet, loud = bytes([128]) * 40_000, bytes(rng.integers(0, 256, 40_000).astype(np.uint8))
    media = spark.createDataFrame([(1, quiet + loud)], "id long, sound binary")
    front = spark.createDataFrame([(1, quiet)], "id long, sound binary")
    assert not np.allclose(audio.fit_limits(media, "id", "sound", most_bytes=32_000), audio.fit_limits(front, "id", "sound", most_bytes=32_000))
    whole = audio.filtered(audio.chroma(np.frombuffer(quiet + loud, np.uint8)))
    assert np.allclose(audio.fit_limits(media, "id", "sound"), np.quantile(whole, [0.25, 0.5, 0.75], axis=0).T)


@pytest.mark.parametrize("collected", [1 << 18, 0])
def test_limits_from_all_recordings(spark, monkeypatch, collected):
    """Every recording counts, also one of 300 that is longer than the rest, and copies and silence as often as they stand."""
    monkeypatch.setattr(audio, "COLLECTED", collected, raising=False)
    rng = np.random.default_rng(6)
    copy = bytes(rng.integers(0, 256, 3000).astype(np.uint8))
    sounds = [copy if j % 7 == 0 else bytes([128]) * 3000 if j % 11 == 0 else bytes(rng.integers(100, 156, 2600 + j).astype(np.uint8)) for j in range(300)]
    sounds += [bytes((128 + 90 * np.sin(np.arange(400_000) ** 1.2 * 0.05)).astype(np.uint8)), b"short", b""]
    media = spark.createDataFrame([*enumerate(sounds), (900, None)], "id long, sound binary").repartition(5)
    values = np.concatenate([audio.filtered(audio.chroma(np.frombuffer(x, np.uint8))) for x in sounds])
    assert np.allclose(audio.fit_limits(media, "id", "sound"), np.quantile(values, [0.25, 0.5, 0.75], axis=0).T, rtol=0, atol=1e-6)


def test_index_is_not_shuffled(spark):
    """Of the index, which is several times the fingerprints, only keys that are asked for are dealt out; all of these are."""
    rng = np.random.default_rng(7)
    prints = [rng.integers(-(2**31), 2**31, 500) for _ in range(200)]
    prints[60][:100] = prints[50][200:300]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(prints)] + [(900, prints[7][50:250].tolist())], "id long, fingerprint array<int>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert [(r["query"], r["recording"], r["offset"]) for r in audio.align(df).collect()] == [(900, 7, -50)]
    assert written() - before < 3 * sum(4 * len(x) for x in prints)


def test_filter_lets_asked_keys_through(spark):
    keys = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, 200_000)
    made = audio.asked_filter(spark.createDataFrame([(int(k),) for k in keys[:100_000]], "key long"))
    assert made.shape[0] > 1 and audio.let_through(made, keys[:100_000]).all() and audio.let_through(made, keys[100_000:]).mean() < 0.03
