import random

from wireloom.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def linked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS root", "'x' AS body").repartition(3)
    return {(r.conv, r.turn): r for r in conversations.link(df).collect()}


def brute(rows):
    """``(conv, turn): (reply_to, root, depth)`` by looking at all messages."""
    parsed = {(c, t): conversations.parse(text or "") for c, t, _, text in rows}
    reply = {}
    for (c, t), (_, _, quotes) in parsed.items():
        votes = {}
        for level, key, length in quotes:
            earlier = [u for (d, u), (_, own, _) in parsed.items() if d == c and u < t and key in {k for k, _ in own}]
            if earlier:
                slot = (level == 1, max(earlier))
                votes[slot] = votes.get(slot, 0) + length
        if votes:
            reply[c, t] = max((direct, n, u) for (direct, u), n in votes.items())[2]
    out = {}
    for c, t in parsed:
        root, depth = t, 0
        while (c, root) in reply:
            root, depth = reply[c, root], depth + 1
        out[c, t] = (reply.get((c, t)), root, depth)
    return out


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 8)
    random.seed(10)
    rows = []
    for conv in range(4):
        said = []
        for turn in range(60):
            own = [f"line {random.randrange(25)} of it" for _ in range(random.randint(1, 4))]
            quote = []
            if said and random.random() < 0.7:
                source = random.choice(said)
                quote = [f"{random.choice(['> ', '>', '>> ', '> > '])}{x.upper()}" for x in source if random.random() < 0.8]
            said.append(own)
            rows.append((conv, turn, "user", "\n".join(quote + own)))
    got = linked(spark, rows)
    assert {k: (r.reply_to, r.root, r.depth) for k, r in got.items()} == brute(rows)


def test_bodies_have_no_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "bot", "On Monday U wrote:\n> Hello there.\n> How are you?\nFine!"), (1, 2, "user", "No quote > here")]
    got = linked(spark, rows)
    assert got[1, 1].body == "Fine!" and got[1, 1].reply_to == 0
    assert got[1, 2].body == "No quote > here" and got[1, 2].reply_to is None
    order = [r.turn for r in conversations.formatted(spark.createDataFrame([tuple(r) for r in got.values()], "conv bigint, turn bigint, role string, body string, reply_to bigint, root bigint, depth bigint")).collect()]
    assert order == [0, 1, 2]


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, 0, None, None), (None, 1, "u", "> a"), (1, None, "u", "> a"), (1, 3, "u", "a"), (1, 4, "u", "> a"), (1, 4, "u", "> a"), (1, 5, "u", ">" * 20_000), (1, 6, "u", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = conversations.link(df).collect()
    assert len(out) == len(rows)
    assert sorted(r.reply_to for r in out if r.reply_to is not None) == [3, 3]
    assert conversations.link(df.limit(0)).count() == 0
