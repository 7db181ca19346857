import math

from fieldloom.operators import proximity


def brute(probes, sites, km):
    for i, a, b in probes:
        for j, c, d in sites:
            if abs(c - a) <= km / 111.0 and abs(d - b) <= km / 111.0 / max(math.cos(math.radians(a)), 0.2):
                h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
                yield i, j, 2 * 6371.0 * math.asin(math.sqrt(h))


def test_rows_of_a_place_are_compared_once(spark):
    """Some places with many rows each, probes that are sites themselves, a site in two places."""
    at = lambda i: (i * 7 % 5 / 4.0, i * 3 % 4 / 4.0)
    probes, sites = [(i, *at(i)) for i in range(60)], [(i, *at(i + 1)) for i in range(200)] + [(3, 0.1, 0.1), (900, 60.0, 0.0)]
    p, s = (spark.createDataFrame(x, f"{k} long, lat double, lon double") for x, k in ((probes, "id"), (sites, "site")))
    assert proximity._places(p, s, 100.0).count() <= 20 * 21
    pairs = list(brute(probes, sites, 100.0))
    told = lambda rows: sorted((*r[:2], round(r[2], 6), *r[3:]) for r in rows)
    assert told(tuple(r) for r in proximity.within_box(p, s, "id", "site").collect()) == told(pairs)
    want, one = [], []
    for i in range(60):
        best = {}
        for _, j, km in (x for x in pairs if x[0] == i):
            best[j] = min(km, best.get(j, km))
        order = sorted((round(km, 9), j) for j, km in best.items())
        one += [(i, order[0][1], order[0][0])]
        want += [(i, j, km, r + 1) for r, (km, j) in enumerate([x for x in order if x[0] <= 100 and x[1] != i][:4])]
    assert told(tuple(r) for r in proximity.nearest(p, s, "id", "site").collect()) == told(one)
    assert told(tuple(r) for r in proximity.k_nearest(p, s, "id", "site").select("id", "site", "km", "rank").collect()) == told(want)
