"""loomtab: a Spark-native engine for tabular ETL and analytics."""

from . import config
from .core import Table, as_table, from_rows
from .errors import ArgumentError, DuplicateKeyError, FieldSelectionError, OrderRequired, TransformError, Unavailable
from .functions.expressions import Record, expr
from .functions.parsers import boolparser, coalesce, dateparser, datetimeparser, nthword, numparser, timeparser
from .operators.aggregates import (
    Conflict, aggregate, diffheaders, diffvalues, fold, groupcountdistinctvalues, groupselectfirst, groupselectlast, groupselectmax, groupselectmin, limits, merge, mergeduplicates, nrows, parsecounter, parsecounts, rowlengths, rowreduce, stats, statsframe, stringpatterncounter, stringpatterns, strjoin, typecounter, typecounts, typeset, valuecount, valuecounter, valuecounts,
)
from .operators.columns import (
    addcolumn, addfield, addfields, addfieldusingcontext, addrownumbers, annex, cut, cutout, extendheader, fieldmap, movefield, prefixheader, pushheader, rename, rowgroupmap, rowmap, rowmapmany, setheader, skip, sortheader, suffixheader, unpack, unpackdict,
)
from .operators.convert import convert, convertall, convertnumbers, format, formatall, interpolate, interpolateall, replace, replaceall, update
from .operators.filters import (
    biselect, facet, rowlenselect, search, searchcomplement, select, selectcontains, selecteq, selectfalse, selectge, selectgt, selectin, selectis, selectisinstance, selectisnot, selectle, selectlt, selectne, selectnone, selectnotin, selectnotnone, selectop, selectrangeclosed, selectrangeopen, selectrangeopenleft, selectrangeopenright, selecttrue, selectusingcontext, skipcomments,
)
from .operators.intervals import (
    collapsedintervals, facetintervallookup, facetintervallookupone, facetintervalrecordlookup, facetintervalrecordlookupone, intervalantijoin, intervaljoin, intervaljoinvalues, intervalleftjoin, intervallookup, intervallookupone, intervalrecordlookup, intervalrecordlookupone, intervalsubtract,
)
from .operators.joins import antijoin, crossjoin, hashantijoin, hashjoin, hashleftjoin, hashlookupjoin, hashrightjoin, join, leftjoin, lookupjoin, outerjoin, rightjoin, unjoin
from .operators.lookups import cache, data, dictlookup, dictlookupone, dicts, facetcolumns, fieldnames, header, listoflists, listoftuples, lookup, lookupone, lookuptable, namedtuples, recordlookup, recordlookupone, records, tupleoflists, tupleoftuples, values
from .operators.lookups import columns_ as columns
from .operators.regex import capture, split, splitdown, sub
from .operators.reshape import flatten, melt, pivot, recast, transpose, unflatten
from .operators.setops import cat, complement, conflicts, diff, distinct, duplicates, hashcomplement, hashintersection, intersection, isunique, recordcomplement, recorddiff, stack, unique
from .operators.show import clock, display, displayall, log_progress, look, lookall, lookallstr, lookstr, progress, see
from .operators.sorts import filldown, fillleft, fillright, head, issorted, mergesort, rowgroupby, rowslice, sort, tail
from .operators.validate import validate
from .sources.avro import appendavro, fromavro, toavro
from .sources.arrays import dummytable, empty, fromarray, fromcolumns, fromdataframe, randomtable, toarray, todataframe, torecarray, valuestoarray, wrap
from .sources.databases import appenddb, create_table, drop_table, fromdb, make_create_table_statement, make_sqlalchemy_column, make_sqlalchemy_table, todb
from .sources.files import (
    appendbcolz, appendcsv, appendpickle, appendtext, appendtsv, frombcolz, fromcsv, fromdicts, fromjson, fromorc, fromparquet, frompickle, fromtext, fromtsv, fromxml, teecsv, teehtml, teepickle, teetext, teetsv, tobcolz, tocsv, tohtml, tojson, tojsonarrays, toorc, toparquet, topickle, totext, totsv, toxml,
)
from .sources.optional import appendgsheet, appendhdf5, appendxlsx, fromgsheet, fromhdf5, fromhdf5sorted, fromxls, fromxlsx, togsheet, tohdf5, toxls, toxlsx
from .sources.registry import (
    BZ2Source, CompressedSource, FileSource, GzipSource, MemorySource, PopenSource, RemoteSource, SMBSource, StdinSource, StdoutSource, StringSource, URLSource, ZipSource, get_reader, get_writer, register_codec, register_reader, register_writer,
)
from .sources.textindex import appendtextindex, fromtextindex, searchtextindex, searchtextindexpage, totextindex

__all__ = [n for n in dir() if not n.startswith("_")]
