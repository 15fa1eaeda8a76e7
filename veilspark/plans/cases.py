"""Small tables written as SQL VALUES, so that queries and their SQL twins read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Texts that recognizers have to find (or leave); ids below 0 keep them apart from documents.
TEXTS = [
    "Acct 123456-78901 and 1234-5678-90",
    "Ref AB1234567 / ABCD12345",
    "Portfolio B08150S page",
    "Plain 1234567890 end",
    "Sec US1729675561 held",
    "ID S1234567D ok",
    "UEN 201912345K and T08LL1234A",
    "Call +65 9123 4567 or 8123-4567",
    "Tel 6512 3456 now",
    "Free 1-800-544-1766 or 800.544.1766",
    "Tel (212) 555-1234 x",
    "Live at 10 Orchard Hill Road #05-12 Singapore 238841 now",
    "Home Blk 123 Ang Mo Kio 560123 unit",
    "Send 742 Old Evergreen Terrace, Springfield Town, IL 62704 please",
    "Mail P.O. Box 1234, Boston, MA 02142 thanks",
    "CAMBRIDGE MA 02142-1057 tail",
    "742 Old Evergreen\nTerrace, Springfield Town, IL 62704",
    "Card 4785380592391139 x",
    "Jane wrote to jane.sample@example.com.",
    "Account Number:    DEMO 12345 67",
    "Pay GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433 now",
    "Card 4111 1111 1111 1111 and 4111-1111-1111-1112",
]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


CASES = "(VALUES " + ", ".join(f"({-i}, {quoted(t)})" for i, t in enumerate(TEXTS, 1)) + ") AS t(doc_id, text)"

# name: (columns, rows); nulls with types come from the first rows or from casts in the queries
TABLES: dict[str, tuple[str, str]] = {
    "spans": ("doc, ord, b, e, type, score", "(1,0,0,20,'A',0.9),(1,1,2,18,'P',0.9),(1,2,4,10,'A',0.8),(2,0,0,8,'A',0.8),(2,1,0,8,'P',0.8),(3,0,5,9,'P',0.9),(3,1,0,12,'A',0.85),(4,0,0,5,'A',0.7),(4,1,6,9,'P',0.9),(5,0,0,30,'I',0.95),(5,1,0,30,'A',0.75),(5,2,3,9,'P',0.95)"),
    "phone_pieces": ("phone, left_, top, right_", "(1,50,100,80),(1,84,100,110),(2,50,100,80),(2,200,101,230),(3,400,100,430),(3,50,112,90),(4,50,100,60),(5,10,10,20),(5,35,11,45),(5,100,12,120),(6,0,100,10),(6,40,100,50),(6,0,140,200)"),
    "votes": ("doc_id, page, model, entity", "(1,1,'trf','Jane Q. Sample'),(1,1,'flair','Jane Q. Sample'),(1,2,'stanza','Jane Q. Sample'),(1,1,'trf','Bob'),(1,2,'trf','Bob'),(1,2,'flair','Ann Lee'),(2,1,'trf','Ann Lee'),(2,1,'flair','Ann Lee'),(2,3,'stanza','J. R. Doe'),(2,3,'trf','J. R. Doe')"),
    "sightings": ("doc_id, page, entity, category, voter", "(1,1,'Jane Q. Sample','PERSON','trf'),(1,2,'Jane Q. Sample','PERSON','flair'),(1,1,'123456-7890','ACCOUNT_NUMBER','regex'),(1,3,'123456-7890','ACCOUNT_NUMBER','regex'),(1,1,'Bob','PERSON','trf'),(1,1,'Ann','OTHER','regex'),(1,2,'Ann','PERSON','trf'),(2,2,'Bob','PERSON','stanza'),(2,1,'Bob','OTHER','regex'),(3,1,'Cyd','PERSON','trf'),(3,2,'Cyd','PERSON','regex'),(3,1,'Dee','PERSON','trf'),(3,1,'Dee','PERSON','regex'),(3,3,'Dee','PERSON','regex')"),
    "page_texts": ("doc_id, page, text", "(1,1,'Dear Mr. Bob and Mrs Ann Lee'),(1,2,'MISS  ann lee met Dr Bob. mr bob'),(2,1,'Prof. J. R. Doe wrote; Sir Nobody'),(2,3,'J. R. Doe again')"),
    "persons": ("doc_id, page, entity", "(1,1,'Bob'),(1,1,'Ann Lee'),(2,1,'J. R. Doe'),(2,2,'J R Doe'),(2,3,'A. B'),(3,1,'Q. Z. Who')"),
    "recs": ("client_id, stem, entity, category, tokenize, token, rejected, n_occ", "('C1','a','Bob','OTHER',CAST(NULL AS BOOLEAN),CAST(NULL AS VARCHAR(20)),CAST(NULL AS BOOLEAN),2),('C1','a','123-4567','ACCOUNT_NUMBER',NULL,'ACCOUNT_1',NULL,1),('C1','b','Bob','PERSON',true,NULL,NULL,1),('C1','b','Zed','PERSON',NULL,NULL,NULL,0),('C1','c','Bob','OTHER',false,'NAME_9',NULL,3),('C1','c','Ann','PERSON',NULL,NULL,NULL,1),('C2','a','Ann','OTHER',NULL,NULL,NULL,1),('C2','b','Ann','ADDRESS',NULL,NULL,NULL,2),('C2','b','Nope','REJECT',NULL,NULL,NULL,2)"),
    "manual": ("client_id, stem, entity, category, tokenize, token", "('C1','a','By Hand','OTHER',true,CAST(NULL AS VARCHAR(20))),('C1','b','By Hand','ADDRESS',NULL,NULL),('C2','b','Extra','PERSON',NULL,'NAME_3'),('C2','b','Untold',NULL,NULL,NULL)"),
    "decisions": ("client_id, stem, entity, category, tokenize, token, rejected", "('C1','a','Bob','OTHER',CAST(NULL AS BOOLEAN),CAST(NULL AS VARCHAR(20)),CAST(NULL AS BOOLEAN)),('C1','b','Zed','PERSON',NULL,NULL,NULL),('C1','c','Ann','PERSON',NULL,NULL,true),('C1','c','Dangling','PERSON',true,NULL,NULL),('C1','c','Bob','PERSON',NULL,NULL,true),('C2','b','Ann','OTHER',true,'OTHER_1',NULL),('C2','b','Extra','PERSON',NULL,NULL,true)"),
    "prior": ("client_id, entity, category, tokenize, token, rejected, first_seen", "('C1','Old One','PERSON',true,CAST('NAME_4' AS VARCHAR(20)),false,'z'),('C1','Bob','OTHER',NULL,NULL,NULL,'z'),('C1','123-4567','ACCOUNT_NUMBER',false,'ACCOUNT_1',false,'z'),('C2','Gone','OTHER',true,NULL,true,'y'),('C3','Only','ADDRESS',false,NULL,false,'x')"),
    "deleted": ("client_id, entity", "('C2','Gone'),('C1','123-4567')"),
    "merge_sets": ("kind, entity, page, line_id", "('U','A',1,1),('U','A',1,2),('B','A',1,1),('B','A',1,2),('B','A',2,5),('R','A',1,1),('R','A',2,5),('R','A',3,7),('U','B',1,4),('R','C',2,2),('R','C',2,3),('B','C',2,2)"),
    "status": ("id, live, tokenized, persisted, has_json", "(1,'analyzing',true,'applied',true),(2,'applying',false,CAST(NULL AS VARCHAR(20)),false),(3,NULL,true,'analyzed',true),(4,NULL,false,'analyzed',true),(5,NULL,false,NULL,true),(6,NULL,false,NULL,false),(7,'error',false,'error',true),(8,'analyzed',true,NULL,true)"),
    "outputs": ("client_id, original_stem, safe_filename, applied_at", "('C1','a','f1',1),('C1','a','f2',3),('C1','b','f3',2),('C2','a','f4',5),('C2','a','f5',5)"),
    "choices": ("entity, category, tokenize, token, rejected, passed", "('Bob','PERSON',CAST(NULL AS BOOLEAN),CAST(NULL AS VARCHAR(20)),CAST(NULL AS BOOLEAN),false),('Ann','PERSON',NULL,NULL,false,false),('Cyd','PERSON',NULL,NULL,true,true),('12-34','ACCOUNT_NUMBER',NULL,NULL,NULL,true),('Road 1','ADDRESS',true,NULL,NULL,true),('56-78','ACCOUNT_NUMBER',false,NULL,NULL,true),('Rej','REJECT',true,NULL,NULL,true),('Off','ADDRESS',true,NULL,NULL,true),('Bare',NULL,true,NULL,NULL,true)"),
    "values": ("doc, ord, entity, category, token, tokenize", "(1,1,'111-1111','ACCOUNT_NUMBER',CAST(NULL AS VARCHAR(20)),true),(1,2,'Bob','PERSON','NAME_2',true),(1,3,'222-2222','ACCOUNT_NUMBER','ACCOUNT_1',true),(1,4,'Ann','PERSON',NULL,true),(1,5,'Cyd','PERSON',NULL,true),(1,6,'333-3333','ACCOUNT_NUMBER','[ACCOUNT_3]',true),(1,7,'444-4444','ACCOUNT_NUMBER',NULL,true),(1,8,'+65 9','SG_PHONE',NULL,true),(1,9,'(212)','PHONE_NUMBER',NULL,false),(1,10,'Bobby','PERSON','NAME_2',true),(2,1,'Ann','PERSON',NULL,true),(2,2,'x','WEIRD',NULL,false)"),
    "box_words": ("page, id, ord, text, left_, right_, top", "(1,'0.0',0,'Hello',50,80,100),(1,'0.1',1,'World',84,114,100),(1,'1.0',2,'Hello',50,80,140),(2,'0.0b',3,'Hello',50,80,100)"),
    "other_words": ("page, ord, text, left_, right_, top", "(1,0,'Hello',51,81,101),(1,1,'Hello',49,79,99),(1,2,'World',90,120,103),(1,3,'Hello',52,82,141),(2,4,'hello',50,80,100)"),
    "boxes": ("page, ord, left_, top, right_, bottom", "(1,0,0,0,100,50),(1,1,10,10,60,40),(1,2,1,1,101,51),(1,3,200,0,300,20),(1,4,0,60,10,70),(2,5,0,0,50,50)"),
    "box_lines": ("page, line_id, left_, top, right_, bottom, content, font_size", "(1,1,12,12,55,20,'first line',10),(1,2,12,24,55,32,'second line',10),(1,3,205,2,290,14,'far right',8),(1,4,500,500,520,510,'alone',12),(2,5,5,5,45,15,'page two',10),(2,6,4,0,70,8,'  sticks out',10),(2,7,6,30,40,38,'  ',10),(2,8,6,36,50,44,' lower ',0)"),
    "typed_paths": ("ord, raw", "(0,' /in/a.pdf '),(1,'\"/in/b.PDF\"'),(2,'/in/none.pdf'),(3,'/in/notes.txt'),(4,' /in/c.pdf'),(5,'/in/.pdf'),(6,'  '),(7,'/in/a.pdf')"),
    "stored_files": ("folder, filename", "('output','a_clean.pdf'),('data','a.pdf'),('data','b.pdf'),('output','b.pdf'),('output','c.PDF'),('data','../x.pdf')"),
    "asked_files": ("id, filename", "(1,'a.pdf'),(2,'b.pdf'),(3,'c.PDF'),(4,'../x.pdf'),(5,'none.pdf'),(6,'a')"),
    "scales": ("id, l, t, w, h, pw, ph, tw, th", "(1,10,20,30,40,100,200,50.0,400.0),(2,0,0,100,200,100,200,100.0,200.0)"),
    "bare_lines": ("page, line_id, left_, top, right_, content", "(1,1,14,13,60,''),(1,2,14,26,90,' '),(1,3,203,1,204,''),(1,4,508,507,600,''),(2,5,300,300,340,''),(2,6,4,4,46,'full')"),
    "bare_words": ("page, ord, left_, top, text", "(1,0,15,27,'word'),(1,1,16,28,'later'),(1,2,204,2,'thin'),(2,3,4,4,'other')"),
    "rules": ("page, x, y0, y1", "(1,30,100,0),(1,40,10,30),(1,250,0,4),(1,260,0,50),(2,25,30,60)"),
    "points": ("point, page, x, y", "(1,1,15,15),(2,1,250,10),(3,1,400,400),(4,2,49,49),(5,1,11,13),(6,1,5,65)"),
    "ink": ("line_id, char, max_delta, share_30", "(1,'a',90,0.0),(1,'b',10,0.0),(1,' ',0,0.0),(2,'a',10,0.01),(2,'b',20,0.02),(2,'c',79,0.05),(2,'d',80,0.0),(3,' ',0,0.0),(4,'x',0,0.06)"),
    "objects": ("doc_id, kind, n", "(1,'info',3),(1,'js',2),(1,'annot',5),(1,'annot',1),(2,'xmp',1),(2,'embedded',0),(3,'openaction',1),(3,'aa',1)"),
    "object_docs": ("doc_id, stem", "(1,'a'),(2,'b'),(3,'c'),(4,'d')"),
    "names": ("id, name", "(1,'Acme Corp.'),(2,'--__a  b!!c__'),(3,'...'),(4,'x-y_z'),(5,'Été & Co'),(6,'_')"),
    "fonts": ("id, family, flags, w, h, rot, x, y", "(1,'Arial-BoldMT',16,595,842,0,10,20),(2,'Times-Italic',2,842,595,90,10,20),(3,'Courier',9,500,500,180,10,20),(4,'HeavyOblique',18,595,842,270,10,20),(5,NULL,0,1,2,360,0,0)"),
    "picked": ("selection, line_id, line_top, line_left, rotation, left_, top, text", "(1,1,10,5,0,30,10,'b'),(1,1,10,5,0,10,10,'a'),(1,2,22,5,0,10,22,'c'),(2,3,10,5,90,5,40,'x'),(2,3,10,5,90,5,80,'w'),(3,4,10,5,180,10,10,'n'),(3,4,10,5,180,60,10,'m'),(4,5,1,1,270,5,90,'q'),(4,5,1,1,270,5,20,'p')"),
    "actions": ("entity, action, category, tokenize", "('Bob','reject',CAST(NULL AS VARCHAR(20)),CAST(NULL AS BOOLEAN)),('Ann','restore',NULL,NULL),('12-34','update','ADDRESS',true),('56-78','update',NULL,true),('Road 1','remove',NULL,NULL),('New','reject','OTHER',NULL)"),
    "decided": ("entity, category, tokenize, token, rejected, shown", "('Bob','PERSON',true,'NAME_1',CAST(NULL AS BOOLEAN),'NAME_1'),('Ann','PERSON',NULL,NULL,true,'NAME_2'),('12-34','ACCOUNT_NUMBER',NULL,'ACCOUNT_1',false,'ACCOUNT_1'),('56-78','ACCOUNT_NUMBER',false,'ACCOUNT_7',NULL,'ACCOUNT_7'),('Road 1','ADDRESS',NULL,NULL,NULL,'ADDRESS_1'),('Same','OTHER',NULL,NULL,NULL,NULL)"),
    "seen_recs": ("entity, category, tokenize, token, n_occ", "('Bob','OTHER',CAST(NULL AS BOOLEAN),CAST(NULL AS VARCHAR(20)),2),('Zed','ACCOUNT_NUMBER',NULL,'ACCOUNT_9',1),('Ann','PERSON',true,NULL,3),('None','OTHER',false,NULL,0),('12-34','ACCOUNT_NUMBER',NULL,NULL,1)"),
    "line_words": ("page, line_id, word_index, text, left_, right_, top, selected", "(1,1,0,'first',12,30,12,true),(1,1,1,'line',34,50,12,false),(1,2,0,'second',12,30,24,false),(1,2,1,'line',34,52,24,true),(2,5,0,'page',8,20,5,true),(2,5,1,'mid',21,30,5,true),(2,5,2,'two',31,44,9,false)"),
    "derived": ("id, left_, right_, left_d, right_d", "(1,10,20,CAST(NULL AS INTEGER),25),(2,5,6,4,7),(3,1,2,NULL,NULL)"),
    "numbers": ("id, raw", "(1,'12.5'),(2,'abc'),(3,CAST(NULL AS VARCHAR(9))),(4,''),(5,'-3'),(6,'1e2')"),
    "glyphs": ("id, content, w", "(1,'abc',2),(2,'abc',6),(3,'   ',3),(4,'ab',1),(5,'',0),(6,'abcd ef',11)"),
    "literals": ("client_id, ord, entity", "('L',0,'a a'),('L',1,'LL 51161 96'),('L',2,'LL5116196'),('L',3,'Smith'),('L',4,'te'),('L',5,'Jane Q. Sample'),('L',6,'742 Evergreen Terrace, Springfield'),('L',7,'DEMO 12345 67'),('L',8,'alpha omega'),('L',9,'of the'),('L',10,'.,;')"),
}

# One document a row: what the matcher's ways have to find in it.
MATCH_DOCS = [
    (1, "a a a\nb a a"),
    (2, "Number LL5116196 and LL51161960 here\nLL 51161 96"),
    (3, "Mr (Smith) and Smith, Smithson\nBlack-Smith Smith's"),
    (4, "statement te (te) x-te-y"),
    (5, "Signed Jane Q. Sample today\nJane\nQ. Sample\nJane other Q other Sample"),
    (6, "742 Evergreen\nTerrace, Springfield, IL\n742 x Evergreen y Terrace z Springfield"),
    (7, "DEMO1234567 DEMO 12345 67\nDEMO 1234567"),
    (8, "alpha one\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine\nten omega\nalpha x omega"),
    (9, "end of\nthe start, most ofthe rest"),
    (10, "   Jane Q. Sample   \nx\n  (Smith)  "),
]


def sql(name: str) -> str:
    columns, rows = TABLES[name]
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


def table(spark: SparkSession, name: str) -> DataFrame:
    """A fixture as a DataFrame; left_ and right_ lose the underscore that keeps them from being SQL keywords."""
    found = spark.sql(f"SELECT * FROM {sql(name)}")
    for c in ("left", "right"):
        found = found.withColumnRenamed(f"{c}_", c)
    return found
