"""Reporting-signal analytics as DataFrame operators.

``functions``  column expressions and fixed word lists
``operators``  DataFrame-in / DataFrame-out operators
``sources``    scans, sinks and the views bound to the bundled tables
``plans``      registered queries with their SQL counterparts
``streaming``  empty on purpose: every source is a dated snapshot
"""
