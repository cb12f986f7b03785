"""Options read when a plan is built or shown."""

look_limit = 5
look_style = "grid"
see_limit = 5
display_limit = 5
#: What a failing conversion does: False gives the error value, True raises, "inline" gives struct<value, error>.
failonerror = False
#: Accepted for compatibility; Spark spills by itself.
sort_buffersize = 100_000
