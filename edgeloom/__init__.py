"""Interaction evidence over labelled graphs, written as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns).  Node ids may be
of any orderable type; the driver tables use BIGINT so that shuffles stay narrow.
"""
