import random

from lakepost.operators.changefeed import live_messages, order_pages, replay_changes

PAGES = "account_id long, start_history_id string, page_token string, upsert_ids array<string>, deleted_ids array<string>, history_id string, next_page_token string"


def test_pages_in_order(spark, collected):
    rows = [(1, "5", f"t{i}" if i else None, None, None, None if i % 3 else "10", f"t{i + 1}" if i < 20 else None) for i in range(21)]
    random.Random(1).shuffle(rows)
    got = {r["page_key"]: (int(r["seq"]), r["place"]) for r in order_pages(spark.createDataFrame(rows + rows[:5], PAGES)).collect()}
    assert len(got) == 21 and all(got[f"t{i}"] == (10, i) for i in range(1, 21))


def test_live_messages(spark, collected):
    messages = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "z")], "account_id long, gmail_message_id string")
    accounts = spark.createDataFrame([(1, "100"), (2, None)], "id long, last_history_id string")
    pages = spark.createDataFrame(
        [
            (1, "90", None, ["old"], ["b"], "99", None),  # already in messages
            (1, "100", None, ["c", None, "  ", "c"], ["a"], "1000", "n"),
            (1, "100", "n", ["d"], ["d", "c"], None, None),  # deleted wins; has the id of the page before
            (1, "100", "n", ["d"], ["d", "c"], None, None),
            (1, "100", None, ["a"], None, "200", None),  # earlier as a number
            (2, "1", None, ["y"], ["z"], "3", None),
        ],
        PAGES,
    )
    assert collected(live_messages(messages, pages, accounts)) == [(1, "b"), (2, "y")]
    assert live_messages(messages, pages.limit(0), accounts).count() == 3


def test_replay_with_partial_columns_against_brute_force(spark):
    rnd = random.Random(4)
    base = [(k, "base", None) for k in range(0, 40, 2)]
    changes = [(rnd.randrange(40), rnd.randrange(200), rnd.choice("UUUD"), rnd.choice([None, f"a{i}"]), rnd.choice([None, f"b{i}"])) for i in range(900)]
    seen, once = set(), []
    for c in sorted(changes, key=lambda c: (c[0], c[1], c[2])):
        if (c[0], c[1]) not in seen:
            seen.add((c[0], c[1]))
            once.append(c)
    state = {k: [a, b] for k, a, b in base}
    for k, _, op, a, b in sorted(once, key=lambda c: (c[0], c[1], c[2])):
        if op == "D":
            state.pop(k, None)
        else:
            old = state.setdefault(k, [None, None])
            state[k] = [a if a is not None else old[0], b if b is not None else old[1]]
    # rows of one key and sequence must be equal for the comparison to be defined
    fed = once + [c for c in once if c[0] % 3 == 0]
    rnd.shuffle(fed)
    schema = "k long, seq long, op string, a string, b string"
    got = replay_changes(spark.createDataFrame(base, "k long, a string, b string"), spark.createDataFrame(fed, schema), ["k"], ["seq"], ["a", "b"])
    assert {r["k"]: [r["a"], r["b"]] for r in got.collect()} == state


def test_hot_key_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        changes = spark.range(2000).selectExpr("1L AS k", "id AS seq", "IF(id % 7 = 0, 'D', 'U') AS op", "CAST(id AS string) AS a")
        got = replay_changes(spark.createDataFrame([], "k long, a string"), changes, ["k"], ["seq"], ["a"]).collect()
        assert [tuple(r) for r in got] == [(1, "1999")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
