"""Common words (articles, particles, pronouns, auxiliaries, conjunctions) of the corpus's languages."""

LANGUAGES = ("hindko", "urdu", "pashto", "persian", "english")

COMMON = {
    "hindko": "دا دی دے دیاں نوں اچ وچ تے نال تھیں وسطے کولوں اپر آپڑے آپڑی ہک ہر اوہ ایہہ اس اناں انہاں ساڈے ساڈی تساں تساڈے توں میں وی جدو جیہڑا جیہڑی جیہڑے کیوں جے پر سی اے ہن ایا ائے ہوسی ہوندا ہوندی ہوندے ویکھیا آکھیا لکھیا رکھیا کیتا بنڑایا ہویا جاندا جاندی جاندے پئے رئے کردے ونڈے سنڑدے لوکاں گلاں طراں ملا کے نیں",
    "urdu": "کا کی کے کو میں سے ہے ہیں نے اور یہ وہ اس ان اپنے اپنی جو جب تو لیکن کیونکہ لیے ایک ہر ہمارے ہماری ہم پر بھی نہیں تھا تھی تھے ہو گا گی گے ہوتا ہوتی ہوتے کیا کہا کہ دیکھا لکھا رکھا گیا گئی بنایا کرتے کرتا جاتا جاتے رہے رہا سنتے بانٹتے ہوا لوگوں باتیں طرح ساتھ ملا کر",
    "pashto": "د په کې ته سره او چې له څخه یو یوه هغه هغوی دا زموږ ستاسو څوک کله نو خپل خپله ځکه خو دی ده دي وو یې کړی شو شي وي به ځي ویلي لیکلی ایښی لیدلی اورېدل کېږي کوي وېشي روان جوړ خلکو ډول",
    "persian": "و از با در را که این آن یک برای هر او ما آنان هنگامی اما زیرا به است بود شد شده خواهد کرده نوشته دیده گفته ساخته نهاده رفت می‌شود می‌کنند می‌روند می‌شنیدند می‌بخشند گونه‌ای",
    "english": "the of and in that is was were are with by for our their a an it not which who whoever every when but because has had have been will knows how from said people near without leaves on up down this",
}
