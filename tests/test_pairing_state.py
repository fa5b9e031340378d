from types import SimpleNamespace

import pandas as pd

from ledgerline.streaming.pairing import Pairing


def test_state_is_read_and_written_once_for_all_that_has_arrived():
    calls, state = [], {"held": None}
    held = SimpleNamespace(get=lambda: calls.append("get") or state["held"], update=lambda v: calls.append("update") or state.update(held=v))
    pairing = Pairing(1000)
    pairing.init(SimpleNamespace(getValueState=lambda *a: held, registerTimer=lambda ms: calls.append("timer")))
    at = pd.Timestamp("2024-01-01")
    rows = lambda *x: iter([pd.DataFrame(list(x), columns=["ts", "side", "items"])])
    made = list(pairing.handleInputRows((7,), rows((at, "po", "b"), (at, "invoice", None), (at, "invoice", "a"), (at, "po", "c")), None))
    assert [r.to_dict("records") for r in made] == [[{"pair_id": 7, "invoice_items": "a", "po_items": "b"}]]
    assert sorted(calls) == ["get", "timer", "update"] and state["held"] == (None, None, True)
    assert list(pairing.handleInputRows((7,), rows((at, "po", "d")), None)) == [] and sorted(calls) == ["get", "get", "timer", "update"]
