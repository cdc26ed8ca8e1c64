"""sectional: rate sectioned documents at corpus scale with Spark DataFrames.

Sub-packages:

- ``sources``   corpus, vector and table readers/writers (S1-S8)
- ``functions`` Column-level text and section functions (P5, P6, T1-T16, U1-U3)
- ``operators`` DataFrame operators: vocabulary, sequences, pooling, profiles,
                metrics, early stopping (A*, J*, K*, W*)
- ``plans``     model jobs (M1-M9) and the registered query catalog
- ``streaming`` Structured Streaming operators (U4)
"""

__version__ = "0.1.0"
