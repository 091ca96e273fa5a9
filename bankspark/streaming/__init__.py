"""Streaming.

The analysed project works on batch tables only (no streams, watermarks or state),
so no streaming operator is built. Every operator of the library is a
``DataFrame -> DataFrame`` function and can be applied to a streaming DataFrame
where Spark allows that operation (projections, filters, stream-static joins and
aggregations in ``complete`` mode); nothing in this package adds to that.
"""
