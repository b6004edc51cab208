"""Delayed, replaceable and cancellable message delivery as Spark jobs.

``functions``  column expressions for headers, instants, ids and the binary metadata header
``operators``  DataFrame -> DataFrame steps: ingest, tagging, replay, routing, counts
``sources``    reading messages and writing deliveries
``streaming``  the Structured Streaming job: per-id state and timers
``plans``      whole jobs put together from the steps
"""
