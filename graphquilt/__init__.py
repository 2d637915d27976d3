"""graphquilt: code and document knowledge graphs as Spark DataFrames.

Every operator takes and returns DataFrames.  Nothing here starts a session;
pass one in, or let ``graphquilt.session.local_session`` build one for tests.
"""

__version__ = "0.1.0"
