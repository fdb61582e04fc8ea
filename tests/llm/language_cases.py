"""Prose and lists of many languages, none of them among the operator's exemplars."""

PROSE = {
'ru':"Вчера вечером мы долго сидели у реки и говорили о том, что случилось летом. Никто не хотел уходить домой, хотя становилось холодно и темно. Мой брат рассказал, как он впервые увидел море и как испугался его. Потом мы развели костёр, и все замолчали.",
'zh':"昨天晚上我们在河边坐了很久，谈论夏天发生的事情。虽然天气变得又冷又黑，但是谁也不想回家。我的弟弟告诉我们他第一次看到大海时是多么害怕。后来我们点起了火，大家都安静下来。",
'ja':"昨日の夜、私たちは川のそばに長いあいだ座って、夏に起きたことを話しました。寒くて暗くなってきましたが、誰も家に帰ろうとしませんでした。弟は初めて海を見たとき、とても怖かったと言いました。",
'el':"Χθες το βράδυ καθίσαμε για πολλή ώρα δίπλα στο ποτάμι και μιλήσαμε για όσα έγιναν το καλοκαίρι. Κανείς δεν ήθελε να γυρίσει στο σπίτι, αν και έκανε κρύο. Ο αδελφός μου μας είπε πώς είδε για πρώτη φορά τη θάλασσα.",
'ar':"جلسنا مساء أمس وقتا طويلا بجانب النهر وتحدثنا عما حدث في الصيف. لم يرغب أحد في العودة إلى البيت، مع أن الجو صار باردا ومظلما. قال لنا أخي كيف رأى البحر لأول مرة وكيف خاف منه.",
'it':"Ieri sera siamo rimasti a lungo seduti vicino al fiume e abbiamo parlato di quello che era successo in estate. Nessuno voleva tornare a casa, anche se faceva freddo ed era ormai buio. Mio fratello ci ha raccontato di quando ha visto il mare per la prima volta.",
'pl':"Wczoraj wieczorem siedzieliśmy długo nad rzeką i rozmawialiśmy o tym, co się stało latem. Nikt nie chciał wracać do domu, chociaż robiło się zimno i ciemno. Mój brat opowiedział, jak po raz pierwszy zobaczył morze i jak się go przestraszył.",
'pt':"Ontem à noite ficamos muito tempo sentados perto do rio e falamos sobre o que tinha acontecido no verão. Ninguém queria voltar para casa, embora estivesse frio e escuro. O meu irmão contou como viu o mar pela primeira vez e como teve medo dele.",
'nl':"Gisteravond zaten we lang bij de rivier en praatten we over wat er in de zomer was gebeurd. Niemand wilde naar huis, hoewel het koud en donker werd. Mijn broer vertelde hoe hij voor het eerst de zee zag en hoe bang hij ervoor was.",
'fi':"Eilen illalla istuimme pitkään joen rannalla ja puhuimme siitä, mitä kesällä oli tapahtunut. Kukaan ei halunnut lähteä kotiin, vaikka tuli kylmä ja pimeä. Veljeni kertoi, miten hän näki meren ensimmäisen kerran ja miten hän pelkäsi sitä.",
'sv':"I går kväll satt vi länge vid floden och pratade om det som hade hänt under sommaren. Ingen ville gå hem, trots att det blev kallt och mörkt. Min bror berättade hur han såg havet för första gången och hur rädd han var för det.",
'tr':"Dün akşam nehrin yanında uzun süre oturduk ve yazın olanlar hakkında konuştuk. Hava soğuk ve karanlık olmasına rağmen hiç kimse eve dönmek istemedi. Kardeşim denizi ilk kez nasıl gördüğünü ve ondan nasıl korktuğunu anlattı.",
'ko':"어제 저녁에 우리는 강가에 오래 앉아서 여름에 있었던 일에 대해 이야기했다. 날이 춥고 어두워졌지만 아무도 집에 가려고 하지 않았다. 내 동생은 처음으로 바다를 보았을 때 얼마나 무서웠는지 말해 주었다.",
'hi':"कल शाम हम नदी के किनारे बहुत देर तक बैठे रहे और गर्मियों में जो हुआ था उसके बारे में बात करते रहे। कोई भी घर नहीं जाना चाहता था, हालाँकि ठंड और अँधेरा हो रहा था। मेरे भाई ने बताया कि उसने पहली बार समुद्र कैसे देखा।",
'uk':"Учора ввечері ми довго сиділи біля річки й говорили про те, що сталося влітку. Ніхто не хотів іти додому, хоча ставало холодно і темно. Мій брат розповів, як він уперше побачив море і як його злякався.",
'ro':"Aseară am stat mult timp lângă râu și am vorbit despre ce s-a întâmplat în vară. Nimeni nu voia să plece acasă, deși se făcea frig și întuneric. Fratele meu ne-a povestit cum a văzut marea pentru prima dată și cât de frică i-a fost.",
'da':"I går aftes sad vi længe ved floden og talte om det, der var sket om sommeren. Ingen ville gå hjem, selv om det blev koldt og mørkt. Min bror fortalte, hvordan han så havet for første gang, og hvor bange han var for det.",
'sw':"Jana jioni tulikaa kwa muda mrefu karibu na mto na tukazungumza juu ya mambo yaliyotokea wakati wa kiangazi. Hakuna mtu aliyetaka kurudi nyumbani, ingawa kulikuwa na baridi na giza. Kaka yangu alituambia jinsi alivyoona bahari kwa mara ya kwanza.",
}

LISTS = {
'ru':["яблоко\nгруша\nлампа\nкамень\nрека\nчайник\nокно\nсад\nмедь\nбумага","яблоко, груша, лампа, камень, река, чайник, окно, сад, медь, бумага, дверь","- молоко\n- хлеб белый\n- сыр\n- масло\n- соль и перец\n- рис","окно медный чайник река занавеска. стол дверь камень; ложка мост тихий лампа бумага дорога сад ковёр"],
'zh':["苹果\n梨\n灯\n石头\n河流\n水壶\n窗户\n花园\n铜\n纸","苹果、梨、灯、石头、河流、水壶、窗户、花园、铜、纸、门、地毯","- 牛奶\n- 面包\n- 奶酪\n- 黄油\n- 大米"],
'ja':["りんご\n机\n電話\n窓\n鉛筆\n傘\n自転車\n時計","牛乳、パン、チーズ、バター、米、塩、砂糖、卵","・牛乳\n・パン\n・チーズ\n・バター"],
'el':["μήλο\nλάμπα\nπέτρα\nποτάμι\nπαράθυρο\nκήπος\nχαρτί","μήλο, λάμπα, πέτρα, ποτάμι, παράθυρο, κήπος, χαρτί, πόρτα, χαλί"],
'ar':["تفاح\nمصباح\nحجر\nنهر\nنافذة\nحديقة\nورق","تفاح، مصباح، حجر، نهر، نافذة، حديقة، ورق، باب، سجادة"],
'it':["mela\nlampada\npietra\nfiume\nfinestra\ngiardino\ncarta","mela, lampada, pietra, fiume, finestra, giardino, carta, porta, tappeto","- latte fresco\n- pane\n- formaggio\n- burro\n- sale e pepe","mela lampada pietra fiume finestra; giardino carta porta tappeto cucchiaio. ponte tavolo verde presto rame tenda silenzio"],
'pl':["jabłko\nlampa\nkamień\nrzeka\nokno\nogród\npapier","jabłko, lampa, kamień, rzeka, okno, ogród, papier, drzwi, dywan"],
'pt':["maçã\nlâmpada\npedra\nrio\njanela\njardim\npapel","maçã, lâmpada, pedra, rio, janela, jardim, papel, porta, tapete"],
'nl':["appel\nlamp\nsteen\nrivier\nraam\ntuin\npapier","appel, lamp, steen, rivier, raam, tuin, papier, deur, tapijt","appel lamp steen rivier raam tuin papier. deur tapijt lepel brug tafel groen vroeg koper gordijn"],
'fi':["omena\nlamppu\nkivi\njoki\nikkuna\npuutarha\npaperi","omena, lamppu, kivi, joki, ikkuna, puutarha, paperi, ovi, matto","omena lamppu kivi joki ikkuna puutarha paperi. ovi matto lusikka silta vihreä kupari verho hiljainen pöytä"],
}
