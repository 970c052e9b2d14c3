"""The state of streams: what is kept of rows that arrive in any order, and that a key costs little."""

import time

from pyspark.sql import Row

from txrisk.streaming import newest


class _List:
    def __init__(self):
        self.values = []

    def get(self):
        return iter(self.values)

    def put(self, values):
        self.values = list(values)


class _Handle:
    def __init__(self):
        self.state = _List()

    def getListState(self, name, schema):
        return self.state


def _row(pos, ts=0, hashed="h", request=None, asked=None):
    return Row(request=request, asked=asked, pos=pos, order_ts=ts, order_block=0, order_index=0,
               order_hash=hashed, fields=f'{{"hash":"{hashed}"}}')


def _processor(k):
    processor = newest._Newest(k)
    handle = _Handle()
    processor.init(handle)
    return processor, handle.state


def test_the_newest_rows_are_kept_once_in_order():
    processor, state = _processor(4)
    arriving = [_row(1, 5), _row(2, 9), _row(3, 9, "a"), _row(4, None), _row(5, 9, None)]
    assert list(processor.handleInputRows(("0x1", 1), iter(arriving), None)) == []
    assert [r[0] for r in state.values] == [3, 2, 5, 1]
    # A replayed row and a newer one; a question comes after both.
    again = [_row(2, 9), _row(6, 10), _row(None, request="q", asked="0X1")]
    out = list(processor.handleInputRows(("0x1", 0), iter(again), None))
    assert [(r.request, r.asked, r.pos) for r in out] == [
        ("q", "0X1", None), (None, None, 6), (None, None, 3), (None, None, 2), (None, None, 5)
    ]
    assert out[1].fields == '{"hash":"h"}'
    # The other pieces give rows only.
    asked = [_row(None, request="q", asked="0X1")]
    assert [r.request for r in processor.handleInputRows(("0x1", 1), iter(asked), None)] == [None] * 4


def test_more_rows_than_are_held_at_once():
    processor, state = _processor(3)
    n = 2 * newest._CHUNK + 7
    list(processor.handleInputRows(("0x1", 0), (_row(i, i) for i in range(n)), None))
    assert [r[0] for r in state.values] == [n - 1, n - 2, n - 3]


def test_a_key_costs_little():
    # Frames made for every key took some 20 ms each, 60 s here.
    start = time.process_time()
    for i in range(3_000):
        processor, _ = _processor(100)
        rows = [_row(j, j) for j in range(10)] + [_row(None, request=str(i))]
        assert len(list(processor.handleInputRows((str(i), 0), iter(rows), None))) == 11
    assert time.process_time() - start < 10
