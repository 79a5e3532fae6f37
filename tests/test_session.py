"""The request session: answers, restarts, and requests that fail."""

import json

import pytest

from phylospan.operators.classify import classify, output_lines, single_reads
from phylospan.operators.index import TaxIndex
from phylospan.sources.fastx import read_fastx
from phylospan.streaming import session
from test_cli_and_blast import library  # noqa: F401


def test_requests(spark, library, tmp_path, monkeypatch):  # noqa: F811
    index = TaxIndex.load(spark, str(library / "db"))
    one, two = str(library / "reads.fq"), str(library / "lib.fa")
    log, out = tmp_path / "log", tmp_path / "out"
    texts = ["PING", f"{one} {two}", "", str(tmp_path / "absent"), two, one, "STOP", one]
    places = [sum(len(t) + 1 for t in texts[:k]) for k in range(len(texts))]
    log.write_text("".join(t + "\n" for t in texts[:5]) + one)  # the sixth line is not complete yet
    answered = session.RequestSession(index, str(log), str(out), str(tmp_path / "cp"))
    summary = lambda k: json.loads((out / f"request={places[k]}" / "summary.json").read_text())
    lines = lambda k: [x for p in sorted((out / f"request={places[k]}" / "lines").glob("part-*")) for x in p.read_text().splitlines()]

    # the fifth request is cut off when its lines are written, before it is done
    kept = session.write_outputs
    calls = []

    def cut_off(*a):
        kept(*a)
        calls.append(a[-1])
        if len(calls) == 2:
            raise RuntimeError("cut off")

    monkeypatch.setattr(session, "write_outputs", cut_off)
    with pytest.raises(Exception, match="cut off"):
        answered.start().processAllAvailable()
    monkeypatch.setattr(session, "write_outputs", lambda *a: (calls.append(a[-1]), kept(*a)))
    first = sorted(p.name for p in (out / f"request={places[1]}" / "lines").iterdir())
    assert lines(4) and not (out / f"request={places[4]}" / "summary.json").exists()

    query = answered.start()
    query.processAllAvailable()
    query.stop()
    assert summary(0)["status"] == "OK" and summary(3)["status"] == "ERROR" and len(list(out.iterdir())) == 4
    for k in (1, 4):
        reads = single_reads(read_fastx(spark, texts[k].split()))
        want = [r.line for r in output_lines(classify(index, reads), reads, index.taxonomy).orderBy("read").collect()]
        assert lines(k) == want and summary(k) == {"request": texts[k], "status": "DONE", "sequences": len(want), "classified": sum(x[0] == "C" for x in want)}
    # what was done before is not repeated
    assert len(calls) == 3 and sorted(p.name for p in (out / f"request={places[1]}" / "lines").iterdir()) == first

    with log.open("a") as f:
        f.write("\nSTOP\n" + one + "\n")
    answered.run()
    assert answered.stopped.is_set() and summary(5)["status"] == "DONE" and summary(6)["status"] == "OK"
    assert not (out / f"request={places[7]}").exists() and len(calls) == 4
    query = answered.start()
    query.processAllAvailable()
    query.stop()
    assert summary(7)["status"] == "DONE" and len(calls) == 5 and lines(7) == lines(5)
