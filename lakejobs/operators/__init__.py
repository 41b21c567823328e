"""DataFrame in, DataFrame out: nothing here collects rows."""
