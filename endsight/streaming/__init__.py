"""Streaming use.

All inputs of the reproduced work are complete files, so there is no streaming
operator.  The stateless projections (``functions``, ``operators.sites.candidate_sites``,
``operators.annotation`` attribute rewriting and model scoring) contain no
shuffle or global state and therefore accept a ``readStream`` DataFrame as is;
``tests/test_streaming.py`` keeps that true.
"""
