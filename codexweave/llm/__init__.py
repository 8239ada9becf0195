"""Training-data operators: each module holds one operator, ``entries`` its queries."""
