"""Near dedup does not hold the exchanges of texts and sets of earlier jobs on disk while it makes the next."""

import glob
import time

from pagemill.llm import minhash


def test_exchanges_of_earlier_jobs_are_gone_before_the_next(spark, monkeypatch):
    made, left, write = {}, {}, minhash.written

    def files():
        return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))

    def watched(df, name, instead_of=None):
        if name in ("sets", "hub_links"):
            until = time.time() + 10  # the cleaner works beside the job
            while (old := files() & made["before"]) and time.time() < until:
                time.sleep(0.1)
            left[name] = old
        out = write(df, name, instead_of)
        if name in ("buckets", "sets"):
            made["before"] = files()
            assert made["before"]
        return out

    monkeypatch.setattr(minhash, "written", watched)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" x{i % 3}") for i in range(30)] + [(100 + i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(30)]
    got = minhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, *range(100, 130)}
    assert left == {"sets": set(), "hub_links": set()}
