"""Criteria and rules on streams: an addition, since every transformation here is row-local."""
