"""lakepost: analytics and search over message archives, planned by Catalyst.

Every operator is a function from DataFrames to a DataFrame.  Nothing outside
``lakepost.llm`` imports ``lakepost.llm``.
"""

__version__ = "0.1.0"
