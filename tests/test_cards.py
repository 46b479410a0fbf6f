"""Cards by layer, drafts and their choice, and regeneration with counts that must add up, over small fixtures."""

import tempfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cards, decks
from graphloom.sources.snapshots import SnapshotLog

CARD = "module string, template string, subject string, answer string, options array<string>"
REVIEW = "module string, template string, subject string, right boolean"


def deck_of(spark, rows):
    log = SnapshotLog(spark, tempfile.mkdtemp(prefix="deck-"))
    log.commit(spark.createDataFrame(rows, CARD))
    return log


def modules(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "module string")


def test_closest_to_entry(spark):
    rows = [("m", "b", 1), ("m", "a", 1), ("m", "c", 1), ("m", "z", 2), ("m", "y", 3), ("m", "x", 3), ("m", "w", 9), ("m", "lost", None)]
    rows += [("flat", p, 0) for p in "abcd"]  # nothing is deeper
    rows += [("one", p, d) for p, d in zip("abcd", (0, 0, 0, 1), strict=True)]  # one deeper file isn't enough
    rows += [("few", p, d) for p, d in zip("abc", (0, 1, 2), strict=True)] + [("few", "d", None)]  # three layered files
    f = spark.createDataFrame(rows, "module string, path string, layer int")
    found = [(r.module, r.answer, r.wrong) for r in cards.closest_to_entry(f, f).collect()]
    assert found == [("m", "a", ["z", "x", "y"])]
    assert cards.closest_to_entry(f.limit(0), f).isEmpty()


def test_drafts_are_counted_by_reason_and_chosen_in_turn(spark):
    rows = [("m", "t", f"s{k}", "told", f"a{k}", ["x", "y"], None) for k in range(9)] + [("m", "u", "s", "told", "a", ["x", "y"], None), ("m", "u", "q", "told", "a", ["a", "y"], "equal options")]
    d = spark.createDataFrame(rows, "module string, template string, subject string, told string, answer string, wrong array<string>, reason string")
    assert [tuple(r) for r in cards.rejections(d).collect()] == [("u", "equal options", 1)]
    got = sorted((r.position, r.template, r.subject) for r in cards.chosen(d).collect())
    assert got == [(0, "t", "s0"), (1, "u", "s"), (2, "t", "s1"), (3, "t", "s2"), (4, "t", "s3"), (5, "t", "s4")]


def test_regeneration_keeps_reviews_of_what_stays(spark):
    old = [("m", "t", "stays", "a", ["a", "b"]), ("m", "t", "turned", "a", ["a", "b"]), ("m", "t", "gone", "a", ["a", "b"]), ("other", "t", "stays", "a", ["a"]), (None, "t", "n", None, None)]
    new = [("m", "t", "stays", "a", ["b", "a"]), ("m", "t", "turned", "b", ["a", "b"]), ("m", "t", "comes", "a", ["a"]), ("other", "t", "ignored", "a", ["a"]), (None, "t", "n", None, None)]
    deck = deck_of(spark, old)
    reviews = spark.createDataFrame([("m", "t", "stays", True), ("m", "t", "stays", None), ("m", "t", "turned", True), ("m", "t", "gone", False), ("other", "t", "stays", True), (None, "t", "n", True), ("m", "t", "never", True)], REVIEW)
    fresh = spark.createDataFrame(new, CARD).withColumn("state", F.lit("clash"))
    counts, rows = decks.regenerate(deck, fresh, modules(spark, "m", None, "m", "bare"), reviews)
    assert counts == {"before": 5, "untouched": 1, "kept": 2, "changed": 1, "created": 1, "deleted": 1, "carried": 4, "set_aside": 2, "reviews": 7, "unknown": 1, "after": 5}
    assert {(r.module, r.subject): (r.state, r.n_reviews, r.n_right) for r in rows.collect()} == {
        ("m", "stays"): ("kept", 2, 1), ("m", "turned"): ("changed", 1, 1), ("m", "gone"): ("deleted", 1, 0), ("m", "comes"): ("created", 0, 0), ("other", "stays"): ("untouched", 1, 1), (None, "n"): ("kept", 1, 1),
    }
    assert deck.versions() == [0, 1]
    assert {(r.module, r.subject, r.answer) for r in deck.read().collect()} == {("m", "stays", "a"), ("m", "turned", "b"), ("m", "comes", "a"), ("other", "stays", "a"), (None, "n", None)}
    assert [r.module for r in decks.without_cards(modules(spark, "m", None, "bare"), rows).collect()] == ["bare"]


def test_counts_that_do_not_add_up_leave_the_deck_alone(spark):
    card = ("m", "t", "s", "a", ["a"])
    deck, none = deck_of(spark, [card]), spark.createDataFrame([], REVIEW)
    with pytest.raises(decks.NotConserved, match="make 1, but 2 were written"):
        decks.regenerate(deck, spark.createDataFrame([card, card], CARD), modules(spark, "m"), none)
    with pytest.raises(ValueError):
        decks.regenerate(deck, spark.createDataFrame([card], CARD), modules(spark), none)
    assert deck.versions() == [0] and deck.read().count() == 1 and len(deck.unfinished()) == 1
    counts, _ = decks.regenerate(deck, spark.createDataFrame([], CARD), modules(spark, "m"), none)
    assert (counts["deleted"], counts["after"]) == (1, 0) and deck.read().isEmpty()
    counts, _ = decks.regenerate(deck, spark.createDataFrame([card], CARD), modules(spark, "m"), none)
    assert (counts["before"], counts["created"], counts["after"]) == (0, 1, 1)
