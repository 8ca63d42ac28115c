"""A run's state is read and written once a batch, however many events it has there."""

from unittest.mock import MagicMock

import pandas as pd

from cartoflow.streaming.lifecycle import Lifecycle


def test_events_of_a_batch_make_no_calls_each():
    run = Lifecycle("run", 86_400_000, 2)
    run.handle, run.known, run.open = MagicMock(), MagicMock(), MagicMock()
    run.known.exists.return_value, run.known.get.return_value = True, (7, 100, 0)
    run.open.iterator.return_value = iter([(("page",), (40,)), (("other",), (50,))])
    kinds = ["finished", *["started", "failed"] * 100, "started"]
    rows = pd.DataFrame({"run": 1, "id": range(202), "kind": kinds, "stage": "page", "at": range(100, 302)})
    out = pd.concat(list(run.handleInputRows((1,), iter([rows]), None)))
    assert out["seq"].tolist() == list(range(8, 210))
    assert out["elapsed_ms"].tolist()[0] == 60 and out["elapsed_ms"].dropna().tolist()[1:] == [1] * 100
    assert [c[0] for c in run.open.method_calls] == ["iterator", "updateValue"]
    run.open.updateValue.assert_called_once_with(("page",), (301,))
    run.known.update.assert_called_once_with((209, 301, 0))
