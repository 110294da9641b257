import math

from arborstream.api import StreamModel, ThresholdedModel


def test_stream_model():
    m = StreamModel(1, 4, 20, 64)
    for i in range(300):
        m.update([math.sin(i / 5)])
    assert m.score([9.0]) > m.score([math.sin(60)]) > 0
    a = m.get_attribution([9.0])
    assert max(a["high"]) == a["high"][-1]
    assert math.isclose(sum(a["high"]) + sum(a["low"]), m.score([9.0]), rel_tol=1e-6)
    assert abs(m.impute([None])[0] - math.sin(60)) < 0.5 and m.impute([2.0]) == [2.0]
    got = m.forecast(5)
    assert len(got) == 5 and max(abs(g[0] - math.sin((300 + i) / 5)) for i, g in enumerate(got)) < 0.8
    assert StreamModel(2).score([1, 2]) == 0.0 and StreamModel(2).forecast(3) == []


def test_thresholded_model():
    m = ThresholdedModel(trees=20, capacity=64)
    assert [m.process([math.sin(i / 5) + (9 if i == 250 else 0)], i).grade > 0 for i in range(260)][250]
