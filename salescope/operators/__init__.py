"""DataFrame -> DataFrame operators: cleaning, feedback, star load, checks, rankings, lookups."""
