"""A topics file of two topics."""

TOPICS = """<top>

<num> Number: 351
<title> Falkland petroleum exploration

<desc> Description:
What information is available on petroleum exploration
in the South Atlantic?

<narr> Narrative:\x20
Any document discussing petroleum exploration is relevant.
Documents on fishing are not relevant.
More text.
</top>

<top>
<num> Number: 352
<title> Tunnel impact
<desc> Description:
Which effects had the tunnel?
<narr> Narrative:\x20
Economic effects count.
</top>
"""
