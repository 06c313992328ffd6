"""Sharding table and URL automaton against plain versions."""

import fnmatch
import random

import pytest

from churnscope.llm import sharding, url_filter


def test_table_is_filled_by_turns():
    shards, size = ["a", "b", "c"], 11
    table = sharding.fill_table(shards, size)
    order = []
    for s in shards:
        at, skip = sharding._hash(f"offset:{s}") % size, sharding._hash(f"skip:{s}") % (size - 1) + 1
        order.append([(at + k * skip) % size for k in range(size)])
    want, turn = {}, 0
    while len(want) < size:
        i = turn % 3
        want[next(slot for slot in order[i] if slot not in want)] = i
        turn += 1
    assert table == [want[s] for s in range(size)]


def test_shares_differ_by_one_and_few_slots_move():
    size = 8191
    one = sharding.fill_table([f"s{i}" for i in range(20)], size)
    shares = [one.count(i) for i in range(20)]
    assert max(shares) - min(shares) <= 1
    two = sharding.fill_table([f"s{i}" for i in range(19)], size)
    moved = sum(a != b for a, b in zip(one, two) if a != 19)
    assert moved < 0.25 * size


@pytest.mark.parametrize("shards,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, size)


def test_rows_keep_their_shard(spark):
    rows = [(1, "x", "old"), (1, "y", "old"), (None, "z", None), (2, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, shard string")
    out = sharding.shard(df, "id").collect()
    assert len(out) == 4 and set(out[0].asDict()) == {"id", "text", "slot", "shard"}
    table = sharding.fill_table(sharding.SHARDS, sharding.TABLE_SIZE)
    for r in out:
        slot = sharding._hash("n" if r.id is None else f"v{r.id}") % sharding.TABLE_SIZE
        assert r.slot == slot and r.shard == sharding.SHARDS[table[slot]]
    assert sharding.shard(df.limit(0), "id").count() == 0


def test_columns_named_like_the_operators_own(spark):
    df = spark.createDataFrame([(1, "a", 7, "b"), (2, "c", 8, "d")], "id long, _shard string, _slot int, __slot string")
    out = {r.id: r for r in sharding.shard(df, "id").collect()}
    assert set(out[1].asDict()) == {"id", "_shard", "_slot", "__slot", "slot", "shard"}
    assert (out[1]._shard, out[1]._slot, out[2]["__slot"]) == ("a", 7, "d")


def test_plan_has_no_python(spark):
    plan = sharding.shard(spark.range(5), "id")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def _plain(url, rules, default):
    host, path = url_filter.canonical(url)
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules
           if (host == h or host.endswith("." + h)) and fnmatch.fnmatchcase(path, p + "*")]
    best = max(fit, key=lambda x: x[:3], default=None)
    return host, path, best and best[3], best[4] if best else default


RULES = [("block", "com", "/*a?c/"), ("allow", "a.com", "/"), ("block", "b.a.com", "/x"), ("allow", "net", "/es/"),
         ("block", "t", "/"), *(("block", f"h{i}.org", f"/p{i}/*/q") for i in range(20))]


def test_automaton_matches_globs(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "B.A.com", "xa.com", "net", "n.net", "t", "h3.org", "y.h19.org", "org/a.com", ""]
    paths = ["", "/", "/es/", "/x", "/xabc/", "/zzaqc/d", "/p3/k/q", "/p19/a/b/q/r", "/p3/q", "/x?y=/es/", "#/x", "/é/aéc/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "a://", "a:///x", "http://a.com:80/x", "http://a.com/" + "k" * 50_000 + "a1c/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(df, rules=RULES, default="keep").collect()}
    assert got == {i: _plain(u, RULES, "keep") for i, u in enumerate(urls)}


def test_no_rows_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(df, rules=()).collect()] == ["allow"]
    assert url_filter.judge_urls(df.limit(0)).count() == 0
