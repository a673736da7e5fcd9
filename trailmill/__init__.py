"""trailmill: behavioural event analytics on Spark DataFrames.

Objects leave *paths* of time-ordered events; properties are either state of
the object (sticky) or belong to one event.  Every operator is a DataFrame
transformation; see ``operators`` for the algebra, ``plans`` for the path
query language and ``sources`` for tables and imports.
"""

__version__ = "0.1.0"
