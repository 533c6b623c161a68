"""Analytics over landed web pages: what changed, what it announces, whom to tell.

Operators take DataFrames and return DataFrames.  Nothing here fetches a page or
sends a message; landed fetch results come in, ranked tables go out.
"""

from tidewatch.session import get_session

__all__ = ["get_session"]
